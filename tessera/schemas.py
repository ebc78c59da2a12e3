"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

SECTIONS = "act_id string, act_name string, year int, jurisdiction string, short_name string, section_id string, section_number string, section_title string, section_text string, source_file string"
CITES_RAW = "source_section_id string, source_act_id string, relationship_type string, target_section_id string, target_section_number string, evidence_text string"
CONCEPT_MAP = "concept_id string, name string, description string, aliases array<string>, maps_to array<struct<section_id:string,relevance:string>>"
ACT = "act_id:string,act_name:string,short_name:string,jurisdiction:string,status:string,in_force_from:string,repeals:array<string>,repealed_by:string,repeal_authority:string,act_priority:int,covers:string,note:string"
ACT_METADATA = f"acts array<struct<{ACT}>>, jurisdiction_aliases string"
CASES = (
    "id string, query string, persona string, expect_status string, jurisdiction_hint string, expect_concepts array<string>, must_cite array<string>, must_cite_any_of array<string>, "
    "must_retrieve array<string>, forbid_cite array<string>, forbid_acts array<string>, expect_text array<string>, forbid_text array<string>, min_confidence double, note string"
)
RULINGS = "ruling_id string, case_name string, court string, year int, citation string, summary string"
EXTRACTION = "struct<legal_concepts:array<string>,jurisdiction:string,employment_type:string,years_of_service:double,monthly_salary:double,triggering_event:string,event_date:string,in_domain:boolean,safety_flag:string>"
