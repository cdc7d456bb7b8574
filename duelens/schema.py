"""Schemas of the tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Fields of a country-level record, in the order of the register form.
RECORD_FIELDS_TEXT = """
eudract_number_with_country text
other_identifiers text
national_competent_authority text
clinical_trial_type text
trial_status text
date_on_which_this_record_was_first_entered_in_the_eudract_data date
trial_results text
trial_results_url text
member_state_concerned text
eudract_number text
full_title_of_the_trial text
title_of_the_trial_for_lay_people_in_easily_understood_i_e_non_ text
name_or_abbreviated_title_of_the_trial_where_available text
sponsor_s_protocol_code_number text
us_nct_clinicaltrials_gov_registry_number text
who_universal_trial_reference_number_utrn text
isrctn_international_standard_randomised_controlled_trial_numbe text
trial_is_part_of_a_paediatric_investigation_plan yes_no
ema_decision_number_of_paediatric_investigation_plan text
sponsors list
imps list
placebos list
trial_medical_condition_s_being_investigated text
trial_medical_condition_in_easily_understood_language text
trial_therapeutic_area text
trial_version text
trial_level text
trial_classification_code text
trial_term text
trial_system_organ_class text
trial_condition_being_studied_is_a_rare_disease text
trial_main_objective_of_the_trial text
trial_secondary_objectives_of_the_trial text
trial_trial_contains_a_sub_study yes_no
trial_full_title_date_and_version_of_each_sub_study_and_their_r text
trial_principal_inclusion_criteria text
trial_principal_exclusion_criteria text
trial_primary_end_point_s text
trial_timepoint_s_of_evaluation_of_this_end_point text
trial_secondary_end_point_s text
trial_diagnosis yes_no
trial_prophylaxis yes_no
trial_therapy yes_no
trial_safety yes_no
trial_efficacy yes_no
trial_pharmacokinetic yes_no
trial_pharmacodynamic yes_no
trial_bioequivalence yes_no
trial_dose_response yes_no
trial_pharmacogenetic yes_no
trial_pharmacogenomic yes_no
trial_pharmacoeconomic yes_no
trial_others yes_no
trial_other_scope_of_the_trial_description text
trial_human_pharmacology_phase_i yes_no
trial_first_administration_to_humans yes_no
trial_bioequivalence_study yes_no
trial_other_trial_type_description text
trial_other yes_no
trial_therapeutic_exploratory_phase_ii yes_no
trial_therapeutic_confirmatory_phase_iii yes_no
trial_therapeutic_use_phase_iv yes_no
trial_controlled yes_no
trial_randomised yes_no
trial_open yes_no
trial_single_blind yes_no
trial_double_blind yes_no
trial_parallel_group yes_no
trial_cross_over yes_no
trial_other_trial_design_description text
trial_other_medicinal_product_s yes_no
trial_placebo yes_no
trial_comparator_description text
trial_number_of_treatment_arms_in_the_trial integer
trial_the_trial_involves_single_site_in_the_member_state_concer yes_no
trial_the_trial_involves_multiple_sites_in_the_member_state_con yes_no
trial_number_of_sites_anticipated_in_member_state_concerned integer
trial_the_trial_involves_multiple_member_states yes_no
trial_number_of_sites_anticipated_in_the_eea integer
trial_trial_being_conducted_both_within_and_outside_the_eea yes_no
trial_trial_being_conducted_completely_outside_of_the_eea yes_no
trial_specify_the_countries_outside_of_the_eea_in_which_trial_s text
trial_if_e_8_6_1_or_e_8_6_2_are_yes_specify_the_regions_in_whic text
trial_trial_has_a_data_monitoring_committee yes_no
trial_definition_of_the_end_of_the_trial_and_justification_wher text
trial_in_the_member_state_concerned_years integer
trial_in_the_member_state_concerned_months integer
trial_in_the_member_state_concerned_days integer
trial_in_all_countries_concerned_by_the_trial_years integer
trial_in_all_countries_concerned_by_the_trial_months integer
trial_in_all_countries_concerned_by_the_trial_days integer
subject_childs integer
subject_adults integer
subject_elderly integer
subject_female yes_no
subject_male yes_no
subject_healthy_volunteers yes_no
subject_patients yes_no
subject_specific_vulnerable_populations yes_no
subject_women_of_childbearing_potential_not_using_contraception yes_no
subject_women_of_childbearing_potential_using_contraception yes_no
subject_pregnant_women yes_no
subject_nursing_women yes_no
subject_emergency_situation yes_no
subject_subjects_incapable_of_giving_consent_personally yes_no
subject_details_of_subjects_incapable_of_giving_consent text
subject_others yes_no
subject_details_of_other_specific_vulnerable_populations yes_no
subject_in_the_member_state integer
subject_in_the_eea integer
subject_in_the_whole_clinical_trial integer
subject_plans_for_treatment_or_care_after_the_subject_has_ended text
competent_authority_decision text
date_of_competent_authority_decision date
ethics_committee_opinion_of_the_trial_application text
ethics_committee_opinion_reason_s_for_unfavourable_opinion text
date_of_ethics_committee_opinion date
end_of_trial_status text
date_of_the_global_end_of_the_trial date
"""

RECORD_FIELDS = dict(line.split() for line in RECORD_FIELDS_TEXT.split("\n") if line)

RECORD_KEY = "eudract_number_with_country"

# Bookkeeping columns of every record.
META_FIELDS = {
    "meta_id": "text",
    "meta_source": "text",
    "meta_created": "timestamp",
    "meta_updated": "timestamp",
}

# Keys of one sponsor entry.
SPONSOR_KEYS = [
    "name_of_sponsor",
    "country",
    "status_of_the_sponsor",
    "name_of_organisation_providing_support",
    "name_of_organisation",
    "functional_name_of_contact_point",
    "street_address",
    "town_city",
    "post_code",
    "telephone_number",
    "fax_number",
    "e_mail",
]

# The columns the study table is built from.
STUDY_SCAN_COLUMNS = [
    "eudract_number",
    "eudract_number_with_country",
    "date_of_the_global_end_of_the_trial",
    "trial_is_part_of_a_paediatric_investigation_plan",
    "end_of_trial_status",
    "trial_status",
    "trial_human_pharmacology_phase_i",
    "trial_therapeutic_exploratory_phase_ii",
    "trial_therapeutic_confirmatory_phase_iii",
    "trial_therapeutic_use_phase_iv",
    "trial_bioequivalence_study",
    "subject_healthy_volunteers",
    "trial_condition_being_studied_is_a_rare_disease",
    "trial_single_blind",
    "full_title_of_the_trial",
    "name_or_abbreviated_title_of_the_trial_where_available",
    "trial_results",
    "sponsors",
]

SPONSOR_ENTRY = T.StructType([T.StructField(k, T.StringType()) for k in SPONSOR_KEYS])
ENTRY_LIST = T.ArrayType(T.MapType(T.StringType(), T.StringType()))

_TYPES = {
    "text": T.StringType(),
    "date": T.DateType(),
    "yes_no": T.BooleanType(),
    "integer": T.IntegerType(),
    "timestamp": T.TimestampType(),
    "list": ENTRY_LIST,
}


def record_schema() -> T.StructType:
    """The record table; sponsors have declared keys, the other lists are maps."""
    fields = []
    for name, kind in {**RECORD_FIELDS, **META_FIELDS}.items():
        spark_type = T.ArrayType(SPONSOR_ENTRY) if name == "sponsors" else _TYPES[kind]
        fields.append(T.StructField(name, spark_type))
    return T.StructType(fields)


def record_csv_schema() -> T.StructType:
    """The record table as a CSV dump: lists are JSON text."""
    fields = []
    for field in record_schema():
        nested = isinstance(field.dataType, T.ArrayType)
        fields.append(T.StructField(field.name, T.StringType() if nested else field.dataType))
    return T.StructType(fields)


def _struct(text: str) -> T.StructType:
    """Schema from lines of 'name type'."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
             "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType()}
    lines = [line.split() for line in text.split("\n") if line.strip()]
    return T.StructType([T.StructField(n, kinds[k]) for n, k in lines])


# Study rows, one per study and raw sponsor name.
TRIAL_SCHEMA = _struct("""
trial_id string
number_of_countries int
min_end_date string
max_end_date string
comp_date int
has_results int
includes_pip int
exempt int
single_blind int
rare_disease int
phase int
bioequivalence_study int
health_volunteers int
trial_status int
any_terminated int
all_terminated int
results_expected int
all_completed_no_comp_date int
sponsor_status int
name_of_sponsor string
trial_title string
trial_url string
comp_date_while_ongoing int
contains_non_eu int
only_non_eu int
""")

# The reviewed sheet of sponsor names.
SHEET_SCHEMA = _struct("""
name_of_sponsor string
normalized_name string
normalized_parent_name string
Proof string
Description string
Notes string
""")

# Headline figures, also one row of the history.
HEADLINE_SCHEMA = _struct("""
scrape_date date
due_date_cutoff date
total_trials long
due_trials long
due_trials_with_results long
due_trials_without_results long
percent_with_results double
inconsistent_trials long
percent_inconsistent double
all_sponsors_count long
major_sponsors_count long
""")

# What is known about one build of the study table.
META_SCHEMA = _struct("""
due_date_cutoff date
got_from_db timestamp
scrape_date date
""")
