"""Table layouts and the text dialect of registry shards.

Registry text files carry no header, so columns are named by position.  Every column is
read as ``string``: codes and keys are zero-padded and must not be turned into integers
(``"01234567"`` and ``"1234567"`` are different keys).  Typing happens later, on purpose,
in :mod:`regspark.functions.clean`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# --- fixed values: positional column names of the three registry tables --------------
EMPRE_COLUMNS = [
    "cnpj_emp", "razao_emp", "nat_jur_emp", "qual_resp_emp", "cap_soc_emp", "port_emp",
    "ent_fed_resp",
]
ESTA_COLUMNS = [
    "cnpj", "cnpj_2", "cnpj_3", "matriz_filial", "fantasia", "sit_cad", "data_sit_cad",
    "mot_sit_cad", "nome_cid_ext", "pais", "dat_ini_at", "cnae", "cnae_2", "tip_log",
    "logradouro", "numero", "complemento", "bairro", "cep", "uf", "municipio", "ddd", "tel1",
    "ddd2", "tel2", "dddfax", "fax", "email", "sit_esp", "dat_sit_exp",
]
SOCIOS_COLUMNS = [
    "cnpj_soc", "id_soc", "nome_socio", "cpf_cnpj", "qual_soc", "dat_ent", "pais", "rep_leg",
    "nome_rep", "qual_rep", "faixa_eta",
]
# --- fixed values: the six dimension archives and the three fact tables -------------
DIMENSION_NAMES = ["Cnaes", "Motivos", "Municipios", "Naturezas", "Paises", "Qualificacoes"]
FACT_TABLE_NAMES = ["Empresas", "Estabelecimentos", "Socios"]
SHARDS_PER_TABLE = 10
# search keywords used to find each fact table among the shard files
TABLE_KEYWORDS = {"empre": "EMPRE", "esta": "ESTA", "socios": "SOC"}
# -------------------------------------------------------------------------------------

DIMENSION_COLUMNS = ["code", "description"]


def string_schema(names: list[str]) -> T.StructType:
    """All-string schema for positional text columns."""
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


EMPRE_SCHEMA = string_schema(EMPRE_COLUMNS)
ESTA_SCHEMA = string_schema(ESTA_COLUMNS)
SOCIOS_SCHEMA = string_schema(SOCIOS_COLUMNS)
DIMENSION_SCHEMA = string_schema(DIMENSION_COLUMNS)

TABLE_SCHEMAS = {"empre": EMPRE_SCHEMA, "esta": ESTA_SCHEMA, "socios": SOCIOS_SCHEMA}


@dataclass(frozen=True)
class Dialect:
    """How a delimited text file is laid out.

    Defaults follow the registry files: ``;`` separated, no header, latin1 bytes,
    ``"`` quotes with doubled-quote escaping.  ``multi_line`` keeps quoted line breaks
    inside one record but makes each file a single split, so it is off unless the text
    really holds line breaks.
    """

    sep: str = ";"
    header: bool = False
    quote: str = '"'
    escape: str = '"'
    encoding: str = "ISO-8859-1"
    multi_line: bool = False
    null_value: str = ""

    def with_(self, **kw) -> "Dialect":
        return replace(self, **kw)

    def read_options(self) -> dict[str, str]:
        return {
            "sep": self.sep,
            "header": str(self.header).lower(),
            "quote": self.quote,
            "escape": self.escape,
            "encoding": self.encoding,
            "multiLine": str(self.multi_line).lower(),
            "nullValue": self.null_value,
            "mode": "PERMISSIVE",
        }

    def write_options(self) -> dict[str, str]:
        return {
            "sep": self.sep,
            "header": str(self.header).lower(),
            "quote": self.quote,
            "escape": self.escape,
            "encoding": self.encoding,
            "quoteAll": "true",
            "nullValue": self.null_value,
            # the writer trims by default; registry text keeps its spaces
            "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false",
        }


REGISTRY = Dialect()
COMMA_WITH_HEADER = Dialect(sep=",", header=True)
COMMA_HEADERLESS = Dialect(sep=",", header=False)
SEMICOLON_WITH_HEADER = Dialect(sep=";", header=True)
