"""Relation and entity vocabularies of the extraction benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values: (dataset, name a model may use, relation it stands for).
RELATIONS = (
    ("ade", "Adverse_Effect", "adverse effect"),
    ("ade", "Adverse_effect", "adverse effect"),
    ("ade", "Adverse_Effect_Rel", "adverse effect"),
    ("conll04", "Work_For", "Work For"),
    ("conll04", "Located_In", "Located In"),
    ("conll04", "OrgBased_In", "Organization based in"),
    ("conll04", "Live_In", "Live In"),
    ("conll04", "Kill", "Kill"),
    ("conll04", "Located_in", "Located In"),
    ("conll04", "OrgBased_in", "Organization based in"),
    ("conll04", "Live_in", "Live In"),
    ("conll04", "Work_for", "Work For"),
    ("conll04", "Killed", "Kill"),
    ("conll04", "Born_in", "Live In"),
    ("conll04", "Died_in", "Live In"),
    ("scierc", "Used_For", "Used-for"),
    ("scierc", "Feature_Of", "Feature-of"),
    ("scierc", "Hyponym_Of", "Hyponym-of"),
    ("scierc", "Part_Of", "Part-of"),
    ("scierc", "Conjunction", "Conjunction"),
    ("scierc", "Compare", "Compare"),
    ("scierc", "Evaluate_For", "Evaluate-for"),
    ("scierc", "Used_for", "Used-for"),
    ("scierc", "Feature_of", "Feature-of"),
    ("scierc", "Hyponym_of", "Hyponym-of"),
    ("scierc", "Part_of", "Part-of"),
)

#: Fixed values: (dataset, name a model may use, entity type).
ENTITY_TYPES = (
    ("ade", "AdverseEffect", "AdverseEffect"),
    ("ade", "adverse_effect", "AdverseEffect"),
    ("ade", "Drug", "Drug"),
    ("ade", "drug", "Drug"),
    ("conll04", "Person", "Person"),
    ("conll04", "person", "Person"),
    ("conll04", "Location", "Location"),
    ("conll04", "location", "Location"),
    ("conll04", "Organization", "Organization"),
    ("conll04", "organization", "Organization"),
    ("conll04", "Other", "Other"),
    ("conll04", "other", "Other"),
    ("scierc", "Entity", "Entity"),
    ("scierc", "entity", "Entity"),
)


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RELATIONS), "dataset string, alias string, relation string")


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENTITY_TYPES), "dataset string, alias string, entity_type string")
