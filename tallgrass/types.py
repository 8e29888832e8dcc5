"""Closed vocabularies and column lists of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ("repository", "issue_number")
PAIR_KEY = (*KEY, "pattern")
SUCCEEDED, ERRORED = "succeeded", "errored"

# Sorted: no order of these lists has a meaning.
ACTIVITY_TYPES = tuple("bug_fix bug_report build_or_dependency conceptual_discussion documentation feature_implementation maintenance migration_or_upgrade other performance_or_gas refactoring security support_question testing_or_verification".split())
CHALLENGES = tuple("access_control data_consistency documentation_or_understanding gas_or_performance governance implementation_complexity interoperability migration none_explicit other privacy_or_confidentiality reliability_or_availability security_risk testing_and_verification tooling_or_dependency upgradeability".split())
ADOPTION = tuple("conceptual_discussion implementation_in_progress implemented_existing insufficient_context not_related problem_with_implementation proposed_or_planned replacement_or_removal superficial_mention".split())
VERDICTS = tuple("insufficient_context no uncertain yes".split())
CONFIDENCE = tuple("high low medium".split())
FALSE_FRIEND = tuple("no uncertain yes".split())
LOCATIONS = tuple("body comment issue_body pull_request_description title".split())
CONTEXT = tuple("insufficient_context sufficient".split())
VOCABULARIES = {"issue_activity_type": ACTIVITY_TYPES, "challenges": CHALLENGES, "adoption_status": ADOPTION, "verdict": VERDICTS, "confidence": CONFIDENCE, "false_friend_detected": FALSE_FRIEND, "evidence_location": LOCATIONS, "context_status": CONTEXT}

REQUIRED_INPUT = ("repository", "issue_number", "issue_title", "issue_body")
OPTIONAL_INPUT = ("repository_category", "concatenated_comments", "type", "labels", "state", "html_url")

#: Columns that the roll-up takes over from the input as they are.
PASSED_ON = tuple("issue_id created_at closed_at labels data_source issue_title issue_body concatenated_comments comments_count comments_count_filtered commits_count raw_text_sha256 sample_group selection_trigger type state".split())
ISSUE_COLUMNS = tuple(
    "issue_id repository_full_name issue_number created_at closed_at labels repository_category repository_category_canonical data_source issue_title issue_body "
    "concatenated_comments comments_count comments_count_filtered commits_count raw_text_sha256 sample_group selection_trigger issue_summary stage1_candidate_count "
    "stage2_pair_count pipeline_error_count input_truncated patterns_present evidence_text evidence_location confidence insufficient_context false_friend_detected "
    "overlapping_patterns issue_activity_type challenge_categories adoption_status relevant_to_pattern_study annotator_id human_notes annotation_date type state "
    "repository issue_key patterns_confirmed patterns_uncertain patterns_insufficient_context issue_challenge_categories".split()
)

CANDIDATE = T.StructType([T.StructField(n, T.StringType()) for n in "pattern evidence_text evidence_location rationale confidence".split()])
STAGE1_PAYLOAD = "issue_summary string, issue_activity_type string, issue_challenge_categories array<string>, context_status string, candidates array<struct<pattern: string, evidence_text: string, evidence_location: string, rationale: string, confidence: string>>"
STAGE2_PAYLOAD = "verdict string, mechanism_match boolean, scope_match boolean, focus_match boolean, evidence_text string, evidence_location array<string>, justification string, adoption_status string, false_friend_detected string, pattern_challenge_categories array<string>, confidence string, alternative_pattern string, overlap_with array<string>"
LEDGER = (
    "stage string, repository string, issue_number string, pattern string, logical_request_id string, call_id string, attempt_number int, provider string, model string, batch_name string, "
    "input_tokens long, output_tokens long, total_tokens long, thoughts_tokens long, cached_input_tokens long, candidate_count long, retrieval_candidate_count long, prompt_chars long, "
    "estimated_input_tokens long, elapsed_seconds double, prompt_tokens_per_second double, generation_tokens_per_second double, response_status string, parsing_status string, error string, "
    "error_type string, transport_error string, timestamp string, generation_parameters map<string,string>"
)
