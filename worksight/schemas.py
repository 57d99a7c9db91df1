"""Fixed values of the works jobs: thresholds, weights, word lists, codes, and the schemas of known exports."""

from __future__ import annotations

from typing import NamedTuple

# ---- fixed values: they decide results and must stay as they are -------------------------------------------------------
NULL_TOKENS = ("", "n/a", "na", "n.a.", "n.a", "-", "--", "—", "–", "null", "nil", "none", "empty", "#n/a", "#value!", "?")
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "yyyy/M/d", "d-MMM-yyyy", "d MMM yyyy", "d-MMMM-yyyy", "yyyy-M-d'T'H:m:s")
LEGACY_DATE_FORMATS = DATE_FORMATS[:6]
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
PRIORITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
SEVERITY_FACTOR = {"LOW": 0.5, "MEDIUM": 1.0, "HIGH": 1.5, "CRITICAL": 2.0}
SIGNAL_WEIGHT = {
    "FIN_PHYS_GAP": 3.0, "COST_ANOMALY": 3.0, "COMPLIANCE": 3.5, "DUPLICATE": 2.5, "DELAY": 2.0, "ML_ANOMALY": 1.5, "AGENCY_CONCENTRATION": 1.5, "DATA_QUALITY": 1.0,
}
WEAK_DUPLICATE_FACTOR = 0.6
GAP_TRIGGER, GAP_CRITICAL = 25, 40
DEVIATION_TRIGGER, DEVIATION_CRITICAL = 40, 60
DELAY_TRIGGER, DELAY_CRITICAL = 90, 180
DUPLICATE_TRIGGER, TEXT_TRIGGER = 0.60, 0.25
GEO_STRONG_M, GEO_MAX_M = 50.0, 2000.0
CONFIDENCE_WEIGHTS = {"geo": 0.55, "vendor": 0.30, "context": 0.15}
VENDOR_STOPWORDS = (
    "sri", "smt", "private", "limited", "ltd", "pvt", "and", "the", "co", "company", "enterprises", "contractors", "constructions", "builders", "works", "agency", "division",
    "department", "engineering",
)
VENDOR_OVERLAP = 0.5
TEXT_STOPWORDS = ("construction", "of", "providing", "at", "the", "and", "in", "to", "renovation", "upgradation", "facility", "work", "works", "building")
SCORE_WEIGHTS = {"text": 0.40, "location": 0.25, "cost": 0.20, "category": 0.10, "time": 0.05}
ANOMALY_TRIGGER, ANOMALY_HIGH = -0.05, -0.15
AGENCY_TRIGGER, AGENCY_CRITICAL, AGENCY_DISTRICT_WORKS, AGENCY_WORKS = 40.0, 60.0, 4, 2
MIN_PEERS = 6
ERROR_ACCEPTABLE, ERROR_DEGRADED, WARNING_DEGRADED = 0.02, 0.10, 0.15
IMPLAUSIBLE_BELOW = 100_000
#: Works that guidelines exclude: code, label, terms in order, severity, basis.
CATEGORY_TERMS = (
    ("RELIGIOUS_STRUCTURE", "Religious structure", ("temple", "mandir", "mosque", "masjid", "church", "gurudwara", "gurdwara", "shrine", "prayer hall", "dargah"), "CRITICAL", "Guidelines para 2.1: works for religious purposes are prohibited"),
    ("MEMORIAL_STATUE", "Memorial / statue", ("memorial", "statue", "pratima", "bust", "samadhi", "smarak"), "CRITICAL", "Guidelines para 2.1: memorials/statues prohibited"),
    ("PRIVATE_PROPERTY", "Private property benefit", ("private school", "private trust", "private society", "private hospital", "personal residence"), "HIGH", "Guidelines para 2.2: works on private property prohibited"),
    ("REPAIR_UNPERMITTED", "Repair/maintenance beyond limits", ("repair of road", "repair work", "annual repair", "maintenance of building", "repainting"), "MEDIUM", "Guidelines: repair/maintenance spend restricted to specified assets/limits"),
    ("OFFICE_BUILDING", "Office building", ("office building", "office complex", "secretariat building", "legislative assembly building"), "HIGH", "Guidelines para 2.1: government office buildings prohibited"),
)
PAYEE_TERMS = (("UNAPPROVED_TRUST", "Trust/society implementing agency", ("trust", "society", "foundation", "seva samiti"), "MEDIUM", "Guidelines: trust/society agencies require State Nodal approval"),)
CASE_TRANSITIONS = {
    "OPEN": ("UNDER_REVIEW", "FIELD_VERIFICATION"),
    "UNDER_REVIEW": ("FIELD_VERIFICATION", "RESOLVED", "ESCALATED"),
    "FIELD_VERIFICATION": ("UNDER_REVIEW", "RESOLVED", "ESCALATED", "CLOSED"),
    "RESOLVED": ("UNDER_REVIEW", "ESCALATED"),
    "CLOSED": ("UNDER_REVIEW",),
    "ESCALATED": ("UNDER_REVIEW",),
}
CONCLUDING = ("RESOLVED", "ESCALATED", "CLOSED")
RESOLUTION_TYPES = ("CONFIRMED_CONCERN", "FALSE_POSITIVE", "NEEDS_VERIFICATION", "NOT_SUBSTANTIATED")
RESOLUTION_REASONS = ("DOCUMENTATION_PROVIDED", "LEGITIMATE_DELAY", "DATA_QUALITY_ISSUE", "FALSE_DUPLICATE_CANDIDATE", "APPROVED_VARIATION", "CONTEXTUAL_EXCEPTION", "OTHER")
DIGEST_FLOOR = {"MINISTRY": "HIGH", "ADMIN": "HIGH"}  # all other roles: CRITICAL
MANDATORY_FIELDS = ("work_id", "state", "district", "description", "estimated_cost", "sanctioned_cost", "financial_progress", "physical_progress")
#: Severity of each rule of each kind of export.
ALLOCATION_RULES = {
    "missing_state": "ERROR", "missing_mp_name": "ERROR", "invalid_amount": "ERROR", "negative_amount": "ERROR", "duplicate_serial": "WARNING", "duplicate_mp_record": "WARNING",
    "implausible_amount": "WARNING", "invalid_serial": "INFO",
}
AGGREGATE_RULES = {"aggregate_consistency_issue": "WARNING", "invalid_count": "ERROR", "invalid_amount": "ERROR"}
WORK_RULES = {
    "missing_work_id": "ERROR", "missing_state": "ERROR", "missing_district": "ERROR", "missing_description": "ERROR", "missing_sanctioned_amount": "ERROR", "invalid_numeric": "ERROR",
    "negative_amount": "ERROR", "progress_out_of_range": "ERROR", "expenditure_above_sanctioned": "WARNING", "invalid_date_order": "WARNING", "invalid_coordinates": "WARNING",
    "duplicate_work_id": "ERROR",
}


class Field(NamedTuple):
    """A canonical field of an export: header keys that stand for it (the first field with the key wins) and whether it must be there."""

    name: str
    keys: tuple[str, ...]
    required: bool = False


class Export(NamedTuple):
    schema_id: str
    dataset_type: str
    fields: tuple[Field, ...]


_SERIAL = Field("serial_number", ("sr_no", "s_no", "serial_no", "sr_number"))
_STATE = Field("state", ("state", "state_name", "state_ut"), True)
_MEMBER = Field("mp_name", ("hon_ble_members_of_parliament", "honble_members_of_parliament", "member_of_parliament", "mp_name", "mp"), True)
_ALLOCATED = Field("allocated_amount", ("allocated_amount_rs_", "allocated_amount", "amount_allocated_rs_"), True)
EXPORTS = (
    Export("ls_allocation_v1", "MP_ALLOCATION", (_SERIAL, _STATE, _MEMBER, Field("constituency", ("constituency", "constituency_name", "parliamentary_constituency")), _ALLOCATED)),
    Export("rs_allocation_v1", "MP_ALLOCATION", (_SERIAL, _STATE, _MEMBER, Field("elected_nominated", ("elected_nominated", "elected_or_nominated")), _ALLOCATED)),
    Export("scheme_aggregate_v1", "SCHEME_AGGREGATE", (
        Field("house", ("house", "lok_sabha_rajya_sabha", "segment")),
        Field("allocated_limit", ("allocated_limit_for_hon_ble_mps", "allocated_limit_for_honble_mps", "allocated_limit")),
        Field("amount_consented_for_calamity", ("amount_consented_for_calamity",)),
        Field("works_recommended", ("works_recommended",)), Field("works_sanctioned", ("works_sanctioned",)), Field("works_completed", ("works_completed",)),
        Field("expenditure_completed_and_ongoing", ("expenditure_on_completed_and_ongoing_works", "expenditure_completed_and_ongoing")),
        Field("as_of_date", ("as_of_date", "as_on_date", "date")),
    )),
    Export("work_level_v1", "WORK_LEVEL", (
        Field("work_id", ("work_id", "workid", "work_no"), True),
        Field("mp_name", ("mp_name", "hon_ble_members_of_parliament", "honble_members_of_parliament", "member_of_parliament")),
        Field("constituency", ("constituency", "constituency_name")), Field("state", ("state", "state_name"), True), Field("district", ("district", "district_name"), True),
        Field("description", ("work_name", "work_description", "description", "work"), True),
        Field("estimated_cost", ("estimated_cost", "estimated_cost_rs_")), Field("sanctioned_amount", ("sanctioned_amount", "sanctioned_cost", "sanctioned_amount_rs_"), True),
        Field("expenditure", ("expenditure", "expenditure_rs_")), Field("physical_progress", ("physical_progress",)), Field("financial_progress", ("financial_progress",)),
        Field("sanction_date", ("sanction_date",)), Field("completion_date", ("completion_date",)), Field("implementing_agency", ("implementing_agency", "agency")),
        Field("latitude", ("latitude", "lat")), Field("longitude", ("longitude", "lon", "lng")), Field("category", ("category", "work_category")), Field("sector", ("sector",)),
        Field("status", ("status", "work_status")), Field("contractor_name", ("contractor_name", "contractor", "vendor")),
        Field("expected_duration_days", ("expected_duration_days", "expected_duration")), Field("start_date", ("start_date",)),
        Field("location_text", ("location", "location_text", "village_town")), Field("payment_ref", ("payment_ref", "payment_id", "payment_no")),
        Field("payment_amount", ("payment_amount", "amount_paid", "payment_amount_rs_")), Field("paid_on", ("paid_on", "payment_date")),
        Field("payee", ("payee", "paid_to", "vendor_name")), Field("payment_stage", ("payment_stage", "stage")),
    )),
)
#: Header keys of the older import path.
LEGACY_KEYS = {
    "work_id": ("work_id", "workid", "id"), "mp_name": ("mp_name", "mp"), "constituency": ("constituency",), "state": ("state",), "district": ("district",), "location_text": ("location", "location_text"),
    "latitude": ("latitude", "latitude_dd", "lat"), "longitude": ("longitude", "longitude_dd", "lon"), "category": ("category",), "sector": ("sector",), "description": ("description", "work_description"),
    "estimated_cost": ("estimated_cost",), "sanctioned_cost": ("sanctioned_cost",), "expenditure": ("expenditure", "exp_amount"), "financial_progress": ("financial_progress",),
    "physical_progress": ("physical_progress",), "sanction_date": ("sanction_date",), "start_date": ("start_date",), "completion_date": ("completion_date",), "status": ("status",),
    "implementing_agency": ("implementing_agency", "agency"), "contractor_name": ("contractor_name", "contractor"), "expected_duration_days": ("expected_duration_days", "expected_duration"),
}
