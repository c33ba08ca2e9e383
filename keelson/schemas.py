"""Schemas of the domain tables."""

from __future__ import annotations

ACTIVITY = (
    "task_code string, uid string, name string, type string, is_milestone boolean, status string, is_critical boolean, "
    "total_float double, original_duration_days double, remaining_duration_days double, target_start date, target_end date, "
    "actual_start date, actual_end date, early_start date, early_end date, late_start date, late_end date"
)
LINK = "predecessor string, successor string, link string, lag_days double, seq long"
REQUIREMENT = (
    "clause_id string, system string, parameter string, canonical_parameter string, value string, unit string, comparison string, "
    "value_max string, tolerance string, mandatory boolean, criticality string, page int, source_text string"
)
PARAMETER = "equipment_tag string, parameter string, canonical_parameter string, value string, unit string, page int, source_text string, seq long"
SUBMITTAL = "vendor string, equipment_tag string, model string, submittal_date date"
RFI_FIELDS = (
    "rfi_id", "subject", "discipline", "status", "priority", "raised_by", "ball_in_court", "date_raised", "date_required",
    "date_responded", "linked_activity", "linked_spec", "equipment_tag", "question", "response", "cost_impact", "schedule_impact",
)
RFI = ", ".join(f"{f} string" for f in RFI_FIELDS)
EVENT = (
    "seq long, agent string, event_type string, entity_id string, entity_type string, severity string, description string, "
    "risk_score double, ts timestamp, extras map<string,string>"
)
NODE = "node_id string, node_type string, attributes map<string,string>, risk_score double, valid_time timestamp, tx_time timestamp"
EDGE = "src string, dst string, relationship string, attributes map<string,string>, valid_time timestamp, tx_time timestamp, seq long"
NCR_LOG = "ncr_id string, seq long, ts timestamp, actor string, action string, disposition string, note string"
PROCEDURES = (
    "procedures array<struct<procedure_id string, title string, system string, equipment_tag string, linked_activity string, tier_target string, "
    "standard_ref string, steps array<struct<step_no int, measurement string, instruction string, unit string, hold_point boolean, critical_hold boolean, "
    "acceptance_criteria struct<operator string, limit double, min double, max double, tolerance double, expected boolean, unit string>>>>>"
)
