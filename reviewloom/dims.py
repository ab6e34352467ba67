"""Dimension tables: aspects, their groups, polarities, code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The aspects in order, with their pedagogical and their confusion group.
ASPECTS = [
    ("clarity", "instructional_quality", "teaching_content"),
    ("lecturer_quality", "instructional_quality", "teaching_content"),
    ("materials", "instructional_quality", "teaching_content"),
    ("feedback_quality", "instructional_quality", "support_friction"),
    ("exam_fairness", "assessment_course_management", "assessment_structure"),
    ("assessment_design", "assessment_course_management", "assessment_structure"),
    ("grading_transparency", "assessment_course_management", "assessment_structure"),
    ("organization", "assessment_course_management", "assessment_structure"),
    ("tooling_usability", "assessment_course_management", "support_friction"),
    ("difficulty", "learning_demand_readiness", "demand_readiness"),
    ("workload", "learning_demand_readiness", "demand_readiness"),
    ("pacing", "learning_demand_readiness", "demand_readiness"),
    ("prerequisite_fit", "learning_demand_readiness", "demand_readiness"),
    ("support", "learning_environment", "support_friction"),
    ("accessibility", "learning_environment", "support_friction"),
    ("peer_interaction", "learning_environment", "support_friction"),
    ("relevance", "engagement_value", "teaching_content"),
    ("interest", "engagement_value", "global_engagement"),
    ("practical_application", "engagement_value", "teaching_content"),
    ("overall_experience", "engagement_value", "global_engagement"),
]
#: Polarity and its score.
POLARITIES = [("negative", -1), ("neutral", 0), ("positive", 1)]
#: Labels so general that a prediction of one of them in place of a missed one counts as broad.
BROAD = ["overall_experience", "interest", "support", "tooling_usability", "feedback_quality"]
#: The aspects that the transfer corpus can show.
OVERLAP = ["lecturer_quality", "overall_experience", "organization", "workload", "grading_transparency", "materials", "exam_fairness", "assessment_design", "accessibility"]
#: Raw opinion codes of the annotation corpus and their polarity.
OPINION_CODES = {"Positive": "positive", "Negative": "negative", "Neutral#Sug": "neutral", "Neutral#NSug": "neutral"}
#: Raw aspect codes of the annotation corpus and their aspect; other codes have none.
ASPECT_CODES = {
    "Lecturer#X_1": "lecturer_quality",
    "Lecturer#X_2": "lecturer_quality",
    "Lecturer#X_3": "lecturer_quality",
    "Lecturer#X_x": "lecturer_quality",
    "Lecturer#X_1_Impli": "lecturer_quality",
    "Lecturer#X_2_Impli": "lecturer_quality",
    "Lecturer#X_3_Impli": "lecturer_quality",
    "Lecturer#X_x_Impli": "lecturer_quality",
    "Course#X_x": "overall_experience",
    "Course#X_x_Impli": "overall_experience",
    "Course_Structure#X_1": "organization",
    "Course_Structure#X_1_Impli": "organization",
    "Course_Structure#X_2": "workload",
    "Course_Structure#X_2_Impli": "workload",
    "Course_Structure#X_5": "grading_transparency",
    "Course_Structure#X_5_Impli": "grading_transparency",
    "Subject_Material#X_1": "materials",
    "Subject_Material#X_1_Impli": "materials",
    "Subject_Material#X_x": "materials",
    "Subject_Material#X_1a": "materials",
    "End_Exam#X_x": "exam_fairness",
    "End_Exam#X_x_Impli": "exam_fairness",
    "End_Exam#X_x2": "exam_fairness",
    "CA#X_x": "assessment_design",
    "CA#X_x_Impli": "assessment_design",
    "Learning_Environment#X_x": "accessibility",
    "Learning_Environment#X_x_Impli": "accessibility",
}


def dim_aspect(spark: SparkSession) -> DataFrame:
    """idx, aspect and its group in each of the three schemes; 20 rows."""
    rows = [(i, a, a, p, c) for i, (a, p, c) in enumerate(ASPECTS)]
    return spark.createDataFrame(rows, "idx int, aspect string, identity string, pedagogical string, confusion string")
