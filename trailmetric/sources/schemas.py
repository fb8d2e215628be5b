"""Explicit schemas of the domain's nested records; free-form parts stay JSON text, whose key order counts. Each is a DDL string."""

from __future__ import annotations

STEP = "step_id string, step_number int, step_type string, content string, tool_name string, tool_input string, tool_output string, metadata string"
GROUND_TRUTH = "task_description string, expected_answer string, task_success boolean, success_criteria string, difficulty string, domain string"
TRAJECTORY = (
    f"trajectory_id string, benchmark string, steps array<struct<{STEP}>>, "
    f"ground_truth struct<{GROUND_TRUTH}>, "
    "metadata string, domain string, complexity string, provenance string, version string"
)
CONVERSATION_ITEM = ("id string, conversations array<struct<from:string, value:string>>, query string, steps array<struct<thought:string, content:string, action:string, tool:string, action_input:string, input:string, observation:string, output:string>>, answer string, success boolean")
GAIA_ITEM = ("task_id string, Question string, `Final answer` string, Level string, `Annotator Metadata` struct<Steps:string, Tools:string>")
SWE_ITEM = ("instance_id string, traj_id string, messages string, resolved boolean, patch string, model string")
ANNOTATION = (
    "annotation_id string, evaluation_unit_id string, annotator_id string, annotation_mode string, created_at string, view_file string, "
    "trajectory_a_variant_id string, trajectory_b_variant_id string, "
    "detectability struct<error_detected:boolean, error_trajectory:string, error_step_id:string, confidence:int>, "
    "consequence struct<error_type:string, impact_tier:int, propagation_depth:int, correctness_a:string, correctness_b:string>, "
    "preference struct<preference:string, preference_reason:string>, time_spent_seconds int, notes string, flagged_for_review boolean"
)
PERTURBATION = (
    "perturbation_id string, original_trajectory_id string, generation_timestamp string, perturbation_class string, perturbation_family string, "
    "perturbation_type string, target_step_index int, target_slot string, original_value string, perturbed_value string, mutation_method string, "
    "expected_impact int, expected_detectability int, propagation_risk array<string>, verified_semantic_change boolean, notes string, generation_status string, "
    "qc_notes string, review_source string, reviewed_at string, qc_checks_passed array<string>, qc_checks_failed array<string>, raw_llm_response string, "
    "llm_parse_success boolean, llm_prompt_name string"
)
ANALYSIS_RESULT = (
    "analysis_id string, experiment_id string, evaluation_unit_id string, judge_model string, "
    "ground_truth struct<perturbation_class:string, perturbation_family:string, perturbation_type:string, target_step_canonical_id:string, expected_impact:int, "
    "expected_detectability:int, benchmark:string, outcome_degradation:double, true_impact_level:int, baseline_outcome_binary:boolean, perturbed_outcome_binary:boolean, "
    "human_error_detected:boolean, human_error_step_id:string, human_impact_tier:double, human_error_type:string>, "
    "judge_output struct<error_detected:boolean, error_confidence:double, predicted_step_canonical_id:string, predicted_error_type:string, localization_confidence:double, "
    "predicted_impact_score:double, predicted_failure_prob:double>, "
    "detection_eval struct<detection_correct:boolean, is_true_positive:boolean, is_false_positive:boolean, is_true_negative:boolean, is_false_negative:boolean, "
    "localization_correct:boolean, localization_distance:int, localization_near:boolean, type_correct:boolean, is_critical_detected:boolean>, "
    "calibration_eval struct<cce:double, abs_cce:double, over_reaction:boolean, under_reaction:boolean, failure_predicted:boolean, failure_actual:boolean, "
    "failure_correct:boolean, impact_tier_predicted:int, impact_tier_error:int>, "
    "human_comparison struct<detection_agrees:boolean, localization_agrees:boolean, type_agrees:boolean, impact_tier_diff:double>"
)
