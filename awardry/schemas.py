"""Schemas of parsed rows, cases and dashboard cases."""

AMOUNT = "type: string, amount: double, description: string"
CLAIM = "struct<relationship: string, amount: double, description: string, is_fla_award: boolean, category: string>"
PLAINTIFF = (
    "struct<plaintiff_id: string, plaintiff_name: string, sex: string, age: int, non_pecuniary_damages: double, "
    "injuries: array<string>, comments: string>"
)
#: A parsed table row. judge, citation, category and region may be a scalar or a JSON list, and are read as text.
PARSED_ROW = (
    "case_name string, plaintiff_name string, defendant_name string, year int, citation string, court string, judge string, "
    "sex string, age int, non_pecuniary_damages double, is_provisional boolean, injuries array<string>, "
    f"other_damages array<struct<{AMOUNT}>>, family_law_act_claims array<{CLAIM}>, comments string, "
    f"plaintiffs array<{PLAINTIFF}>, is_continuation boolean"
)
#: A parsed case: a parsed row with where it stood. ord is the order of input.
PARSED_CASE = PARSED_ROW + ", source_page int, category string, region string"
#: A case of the older flat shape.
FLAT_CASE = (
    "region string, raw_fields array<string>, summary_text string, case_name string, year int, court string, damages double, embedding array<float>"
)
EXTENDED = (
    "struct<injuries: array<string>, regions: array<string>, categories: array<string>, sex: string, age: int, "
    f"other_damages: array<struct<{AMOUNT}>>, num_plaintiffs: int, plaintiffs: array<{PLAINTIFF}>, comments: string, "
    f"judges: array<string>, family_law_act_claims: array<{CLAIM}>>"
)
#: A case as the dashboard reads it.
DASHBOARD_CASE = (
    "id string, case_name string, year int, court string, judge array<string>, citation string, source_page int, category string, region string, "
    "damages double, non_pecuniary_damages double, pecuniary_damages double, total_award double, comments string, "
    f"extended_data {EXTENDED}, summary_text string, embedding array<float>"
)
CPI = "year int, cpi double"
