"""Fixed schemas and fixed values of the data model.

Long tables are the working form everywhere; nested structs are built only
at the sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results): the twelve
# requirement types in configured order with their weightings (sum 100),
# the score range, the requirement kinds and the entity labels.
# ---------------------------------------------------------------------------
REQUIREMENT_TYPES: list[tuple[str, int]] = [
    ("work_experience", 25),
    ("education", 15),
    ("other_qualifications", 10),
    ("hard_skills", 15),
    ("soft_skills", 10),
    ("specific_knowledge", 5),
    ("personal_traits", 5),
    ("languages", 5),
    ("travel", 2),
    ("location", 2),
    ("working_hours", 3),
    ("physical_ability", 3),
]
MIN_SCORE = 0
MAX_SCORE = 100
KIND_MANDATORY = "mandatory"
KIND_OPTIONAL = "optional"
MODEL_ENTITY = "model"
CONSENSUS_ENTITY = "consensus"
MEAN_LABEL = "mean"

# Own short definitions of the requirement types (used in request texts).
REQUIREMENT_DEFINITIONS: dict[str, str] = {
    "work_experience": "Earlier roles and the time spent in them.",
    "education": "Degrees, diplomas, vocational training and fields of study.",
    "other_qualifications": "Licences, certificates and accreditations.",
    "hard_skills": "Technical abilities needed to do the work.",
    "soft_skills": "Ways of working with other people, such as communication.",
    "specific_knowledge": "Knowledge of particular areas relevant to the role.",
    "personal_traits": "Personality traits that fit the role and the team.",
    "languages": "Languages and the level of proficiency in them.",
    "travel": "Travel beyond the daily commute.",
    "location": "Place of work: on site, remote or hybrid.",
    "working_hours": "Hours, weekends, part time or full time.",
    "physical_ability": "Physical demands such as standing or lifting.",
}

REQUIREMENT_TYPE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("definition", T.StringType(), False),
    T.StructField("weighting", T.IntegerType(), False),
])


def requirement_types(spark: SparkSession,
                      weights: list[tuple[str, int]] | None = None) -> DataFrame:
    """Requirement-type dimension ``(type, ord, definition, weighting)``.

    Twelve rows: a fixed, bounded dimension (safe to broadcast).
    """
    rows = [(t, i, REQUIREMENT_DEFINITIONS.get(t, t), int(w))
            for i, (t, w) in enumerate(weights or REQUIREMENT_TYPES)]
    for t, _, _, w in rows:
        if w <= 0:
            raise ValueError(f"weighting of {t} must be > 0")
    return spark.createDataFrame(rows, REQUIREMENT_TYPE_SCHEMA)
