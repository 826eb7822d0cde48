"""From a graph service's records to labelled triples and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The sentence template of each edge type.
RELATIONS = {
    "AFFECTS_CamG": "In the field of oncology, compound {} affects mutated gene",
    "ASSOCIATES_DaG": "In genetics, disease {} associates with gene",
    "BINDS_CbP": "In biochemistry, compound {} binds protein",
    "BINDS_CbPD": "In biochemistry, compound {} binds with protein domain",
    "CATALYZES_ECcR": "Enzymatic activity {} catalyzes metabolic reaction",
    "CAUSES_CcSE": "Symptom {} can be caused by the side effect of Compound",
    "CAUSES_OcD": "Organism {} may cause disease",
    "CLEAVESTO_PctP": "Protein {} cleaves into protein",
    "CONSUMES_RcC": "In metabolic reactions, reaction {} consumes compound",
    "CONTAINS_FcC": "Food {} contains compound",
    "CONTRAINDICATES_CcD": "Compound {} is contraindicated in disease",
    "DECREASEDIN_PdD": "Protein {} is decreased in disease",
    "DOWNREGULATES_AdG": "Gene {} downregulated in tissue",
    "DOWNREGULATES_CdG": "Compound {} downregulates gene",
    "DOWNREGULATES_GPdG": "Gene product {} downregulates gene",
    "DOWNREGULATES_KGdG": "Knocked-out gene {} downregulates target gene",
    "DOWNREGULATES_OGdG": "Overexpressed gene {} downregulates target gene",
    "ENCODES_GeP": "Gene {} encodes protein",
    "ENCODES_OeP": "Organism {} encodes protein",
    "EXPRESSES_ACTeG": "Anatomy cell type {} expresses gene",
    "EXPRESSES_AeG": "Anatomy {} expresses gene",
    "HAS_PhEC": "Protein {} has enzymatic activity",
    "INCLUDES_PCiC": "Pharmacological class {} includes compound",
    "INCREASEDIN_PiD": "Protein {} is increased in disease",
    "INTERACTS_PDiPD": "Protein domain {} interacts with protein domain",
    "INTERACTS_PiP": "Protein {} interacts with protein",
    "ISA_AiA": "Anatomy {} is a type of anatomy",
    "ISA_DiD": "Disease {} is a type of disease",
    "ISA_ECiEC": "Enzymatic activity {} is a type of enzymatic activity",
    "ISA_FiF": "Food {} is a type of food",
    "ISA_OiO": "Organism {} is a type of organism",
    "ISA_PWiPW": "Pathway {} is a type of pathway",
    "ISIN_ACTiiA": "Anatomy cell type {} is localized in anatomy",
    "ISIN_ACTiiCT": "Anatomy cell type {} belongs to cell type",
    "LOCALIZES_DlA": "Disease {} localizes to anatomy",
    "MEMBEROF_PDmPF": "Protein domain {} is a member of protein family",
    "PARTICIPATES_GpBP": "Gene {} participates in biological process",
    "PARTICIPATES_GpCC": "Gene {} participates in cellular component",
    "PARTICIPATES_GpMF": "Gene {} participates in molecular function",
    "PARTICIPATES_GpPW": "Gene {} participates in pathway",
    "PARTOF_ApA": "Anatomy {} is part of anatomy",
    "PARTOF_PDpP": "Protein domain {} is part of protein",
    "PARTOF_PpPwG": "Protein {} is part of pathway group",
    "PARTOF_PwpPw": "Pathway group {} is part of pathway group",
    "PRESENTS_DpS": "Disease {} presents symptom",
    "PRESENTS_GpS": "Gene {} associates with symptom",
    "PRODUCES_RpC": "Reaction {} produces compound",
    "RESEMBLES_DrD": "Disease {} resembles disease",
    "TRANSPORTS_PtC": "Protein {} transports compound",
    "TREATS_CtD": "Compound {} treats disease",
    "UPREGULATES_AuG": "Gene {} upregulated in tissue",
    "UPREGULATES_CuG": "Compound {} upregulates gene",
    "UPREGULATES_GPuG": "Gene product {} upregulates gene",
    "UPREGULATES_KGuG": "Knocked-out gene {} upregulates target gene",
    "UPREGULATES_OGuG": "Overexpressed gene {} upregulates target gene",
}
DEFAULT_PROVENANCE = "SPOKE-KG"
# Node types that a query of the service leaves out, and its cutoffs.
EXCLUDED_TYPES = ("DatabaseTimestamp", "Version")
CUTOFFS = {
    "cutoff_Compound_max_phase": 3,
    "cutoff_Protein_source": ["SwissProt"],
    "cutoff_DaG_diseases_sources": ["knowledge", "experiments"],
    "cutoff_DaG_textmining": 3,
    "cutoff_CtD_phase": 3,
    "cutoff_PiP_confidence": 0.7,
    "cutoff_ACTeG_level": ["Low", "Medium", "High"],
    "cutoff_DpL_average_prevalence": 0.001,
    "depth": 2,
}


def relation_table(spark: SparkSession, extra: dict[str, str] | None = None) -> DataFrame:
    """(edge_type, template): some 60 rows, always joined by broadcast."""
    return spark.createDataFrame(list({**RELATIONS, **(extra or {})}.items()), "edge_type string, template string")


def is_edge(kind: Column) -> Column:
    """Edge records have an underscore in their type, node records none."""
    return F.contains(kind, F.lit("_"))


def node_name() -> Column:
    """A protein's description, else the name, else the identifier."""
    p = F.col("properties")
    return F.coalesce(F.when(F.col("neo4j_type") == "Protein", p["description"]).otherwise(p["name"]), p["identifier"])


def provenance(p: Column, default: str = DEFAULT_PROVENANCE) -> Column:
    """sources (joined, even if empty), else source, else the preprint list, else the default.

    The lists of preprints and publications are text such as "['a', 'b']"; the
    reference's branches for publications never apply, so neither do they here.
    """
    preprints = F.regexp_replace(p["preprint_list"], r"[\[\]'\"]", "")
    return F.coalesce(F.array_join(p["sources"], ", "), p["source"], F.nullif(F.trim(preprints), F.lit("")), F.lit(default))


def nodes(records: DataFrame, excluded: tuple[str, ...] = EXCLUDED_TYPES) -> DataFrame:
    kind = F.col("neo4j_type")
    return records.where(~is_edge(kind) & ~kind.isin(*excluded)).select(kind.alias("node_type"), F.col("id").alias("node_id"), node_name().alias("node_name"))


def edges(records: DataFrame) -> DataFrame:
    p = F.col("properties")
    return records.where(is_edge(F.col("neo4j_type"))).select("source", F.col("neo4j_type").alias("edge_type"), "target", provenance(p).alias("provenance"), F.to_json(p).alias("evidence"))


def as_variant(edge_table: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Evidence, the whole bag of properties, as a VARIANT: read once, whatever fields it has. Text that is no JSON is null."""
    return edge_table.withColumn(evidence, F.try_parse_json(evidence))


def evidence_value(evidence: Column, path: str, kind: str = "string") -> Column:
    """What a VARIANT holds at a path such as "$.sources[0]", null if it is not there or of another kind."""
    return F.try_variant_get(evidence, path, kind)


def evidence_fields(edge_table: DataFrame, evidence: str = "evidence") -> DataFrame:
    """(edge_type, fields): the schema that the evidence of each type of edge has over all its rows."""
    return edge_table.groupBy("edge_type").agg(F.schema_of_variant_agg(evidence).alias("fields"))


def name_ends(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges with names in place of node ids; edges with an unknown end go."""
    for end in ("source", "target"):
        lookup = node_table.select(F.col("node_id").alias(end), F.col("node_name").alias(f"{end}_name"))
        edge_table = edge_table.join(lookup, end)
    rest = [c for c in edge_table.columns if c not in ("source", "target", "source_name", "target_name")]
    return edge_table.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), *rest)


def label(edge_table: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds template, null for an unknown edge type."""
    return edge_table.join(F.broadcast(relations), "edge_type", "left")


def clean_triples(edge_table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct triples with a template: what the knowledge graph is built from. ``columns``, if not all, are
    chosen before rows are compared, so that templates need not be held beside each triple."""
    known = edge_table.where(F.col("template").isNotNull())
    return (known.select(*columns) if columns else known).dropDuplicates()


def fact(template: Column, source: Column) -> Column:
    """The template with its one slot filled."""
    return F.replace(template, F.lit("{}"), source)


def evidence_text(template: Column, source: Column, target: Column) -> Column:
    """A step of a path in words, entities in angle brackets."""
    return F.concat(F.replace(template, F.lit("{}"), F.concat(F.lit("<"), source, F.lit(">"))), F.lit(" <"), target, F.lit(">"))


def predicate(edge_type: Column) -> Column:
    """The type's part before its first underscore (of the code, not of its template)."""
    return F.substring_index(edge_type, "_", 1)


def sentence(with_evidence: bool = False) -> Column:
    """An edge as a sentence of context, over source, edge_type, target, provenance (and evidence)."""
    start = F.concat("source", F.lit(" "), F.lower(predicate(F.col("edge_type"))), F.lit(" "), "target", F.lit(" and Provenance of this association is "), "provenance")
    if not with_evidence:
        return F.concat(start, F.lit("."))
    return F.concat(start, F.lit(" and attributes associated with this association is in the following JSON format:\n "), F.coalesce("evidence", F.lit("None")), F.lit("\n\n"))


def tail_sentence(node: Column, source: Column, identifier: Column) -> Column:
    """What follows the context: where the node's identifier is from (no space in front)."""
    return F.concat(node, F.lit(" has a "), source, F.lit(" identifier of "), identifier, F.lit(" and Provenance of this is from "), source, F.lit("."))


def instruction(system: Column, question: Column) -> Column:
    """A chat instruction with a system prompt."""
    return F.concat(F.lit("[INST]"), F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"), question, F.lit("[/INST]"))


def triples(records: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Records to clean labelled triples in one plan."""
    named = name_ends(edges(records), nodes(records))
    return clean_triples(label(named, relation_table(records.sparkSession, extra)).select("source", "edge_type", "target", "template"))
