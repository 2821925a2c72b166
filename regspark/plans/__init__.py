"""End-to-end plans and the registered query catalog."""

from regspark.plans.company_partners import company_partners, company_partner_counts

__all__ = ["company_partners", "company_partner_counts"]
