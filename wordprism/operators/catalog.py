"""Artifact names, the artifact store and the queries that choose artifacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordprism.plans.tables import stored

# Name parts of the artifact kinds.
#   <dataset>-<n>_text
#   <dataset>-<n>_<model>_token_info
#   <dataset>-<n>_<model>-b<layer>_sentence_proj-<method>
#   <dataset>-<n>_<model>-b<layer>_class_explanation-<method>
KINDS = {"text": None, "token": "info", "sentence": "proj", "class": "explanation"}
_LAYER = r"-b(\d+)$"


def parse_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Add ``dataset, model, layer, kind, opt, method`` read from artifact names."""
    stem = F.regexp_replace(F.regexp_replace(F.col(name), r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    part = F.split(stem, "_")
    short = F.size(part) == 2
    full_model = F.when(~short, F.get(part, F.lit(1)))
    tail = F.split(F.get(part, F.lit(3)), "-")
    return names.select(
        "*",
        F.get(part, F.lit(0)).alias("dataset"),
        F.regexp_replace(full_model, _LAYER, "").alias("model"),
        F.when(full_model.rlike(_LAYER), F.regexp_extract(full_model, _LAYER, 1)).cast("int").alias("layer"),
        F.when(short, F.get(part, F.lit(1))).otherwise(F.get(part, F.lit(2))).alias("kind"),
        F.when(~short, F.get(tail, F.lit(0))).alias("opt"),
        F.when(~short, F.get(tail, F.lit(1))).alias("method"),
    )


def artifact_name(dataset: Column, model: Column, layer: Column, kind: Column, method: Column) -> Column:
    """The inverse of :func:`parse_names`."""
    block = F.concat(model, F.lit("-b"), layer.cast("string"))
    return (
        F.when(kind == "text", F.concat_ws("_", dataset, F.lit("text")))
        .when(kind == "token", F.concat_ws("_", dataset, model, F.lit("token_info")))
        .when(kind == "sentence", F.concat_ws("_", dataset, block, F.concat(F.lit("sentence_proj-"), method)))
        .when(kind == "class", F.concat_ws("_", dataset, block, F.concat(F.lit("class_explanation-"), method)))
    )


def models(catalog: DataFrame) -> DataFrame:
    """Sorted distinct ``<dataset>_<model>[-b<layer>]`` of projections and explanations."""
    block = F.concat("model", F.coalesce(F.concat(F.lit("-b"), F.col("layer").cast("string")), F.lit("")))
    listed = catalog.where(~F.col("kind").isin("text", "token"))
    return listed.select(F.concat_ws("_", "dataset", block).alias("model")).distinct().orderBy("model")


def _same_model(dataset: str, model: str, layer: int | None) -> Column:
    block = F.col("layer").isNull() if layer is None else F.col("layer") == layer
    return (F.col("dataset") == dataset) & (F.col("model") == model) & block


def with_methods(rows: DataFrame, catalog: DataFrame, dataset: str, model: str, layer: int | None) -> DataFrame:
    """Add ``projections`` and ``explanations``: the methods that exist for a model, by name, as every reply lists them."""
    own = catalog.where(_same_model(dataset, model, layer))

    def listed(kind: str) -> Column:
        return own.agg(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("method"))))).scalar()

    return rows.withColumn("projections", listed("sentence")).withColumn("explanations", listed("class"))


def filter_model(catalog: DataFrame, dataset: str, model: str, layer: int | None) -> DataFrame:
    """What to load for a model: texts, token info, first projection and explanation.

    Methods are taken in name order, in which ``PCA`` comes before ``UMAP`` and
    both come before ``tSNE``.
    """
    block = _same_model(dataset, model, layer)
    loads = (
        ((F.col("dataset") == dataset) & (F.col("kind") == "text"))
        | ((F.col("dataset") == dataset) & (F.col("kind") == "token") & (F.col("model") == model))
        | (block & F.col("kind").isin("sentence", "class"))
    )
    rows = catalog.where(loads)
    return rows.groupBy("dataset", "kind").agg(
        F.min("method").alias("method"),
        F.array_sort(F.collect_set("method")).alias("methods"),
    )


def filter_projection(catalog: DataFrame, dataset: str, model: str, layer: int | None, method: str) -> DataFrame:
    """Artifacts for a change of projection: the texts and the named projection, with the method lists."""
    wanted = _same_model(dataset, model, layer) & (F.col("kind") == "sentence") & (F.col("method") == method)
    rows = catalog.where(wanted | ((F.col("dataset") == dataset) & (F.col("kind") == "text")))
    return with_methods(rows, catalog, dataset, model, layer)


def filter_explanation(catalog: DataFrame, dataset: str, model: str, layer: int | None, method: str) -> DataFrame:
    """Artifacts for a change of explanation: token info and the named explanation, with the method lists."""
    wanted = _same_model(dataset, model, layer) & (F.col("kind") == "class") & (F.col("method") == method)
    tokens = (F.col("dataset") == dataset) & (F.col("kind") == "token") & (F.col("model") == model)
    return with_methods(catalog.where(wanted | tokens), catalog, dataset, model, layer)


def label_projection(projection: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels of the texts onto projection rows, by text id."""
    label = F.coalesce("label", "topic")
    return projection.join(texts.select("text_id", label.alias("label")), "text_id")


def tokens_of_explanation(attribution: DataFrame, occurrence: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Occurrences of the tokens of an explanation.

    ``index`` holds the tokens of the same occurrences where they are had without spans.

    A token of the explanation that the index does not know is an error, raised
    by the task that meets it. The check needs one row per token of the index. The checked
    tokens are written, so that the planner knows how few they are and sends them to
    the occurrences instead of moving all occurrences by token.
    """
    wanted = attribution.select("token").distinct()
    known = (occurrence if index is None else index).groupBy("token").agg(F.lit(True).alias("_known"))
    failing = F.raise_error(F.concat(F.lit("no token info for "), F.col("token"))).cast("string")
    checked = wanted.join(known, "token", "left").select(F.when(F.col("_known"), F.col("token")).otherwise(failing).alias("token"))
    return occurrence.join(stored(checked, "explained"), "token", "left_semi")


# --- artifact store -------------------------------------------------------------


# Number columns repeat: dictionaries of up to 4 MB, tested on pages of up to 8 MB, keep them small and exact.
_PARQUET = {"parquet.dictionary.page.size": 1 << 22, "parquet.page.size": 1 << 23, "parquet.page.row.count.limit": 1 << 18}
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def write_artifact(df: DataFrame, root: str, name: str, partitions: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Write one kind of artifact as parquet, partitioned for pruned reads.

    Only the partitions present in ``df`` are replaced. A task keeps the files of its first
    partitions open and sorts rows only beyond them, so a table of few partitions is written as it comes.
    """
    conf = df.sparkSession.conf
    before = conf.get(_OPEN_FILES)
    writer = df.write.mode(mode).options(**_PARQUET).option("partitionOverwriteMode", "dynamic")
    if partitions:
        writer = writer.partitionBy(*partitions)
    conf.set(_OPEN_FILES, "16")
    try:
        writer.parquet(f"{root.rstrip('/')}/{name}")
    finally:
        conf.set(_OPEN_FILES, before)


def _keyed(df: DataFrame, **keys) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in keys.items()})


def save_texts(texts: DataFrame, root: str, dataset: str) -> None:
    write_artifact(_keyed(texts, dataset=dataset), root, "text", ("dataset",))


def save_features(token_vec: DataFrame, root: str, dataset: str, model: str) -> None:
    write_artifact(_keyed(token_vec, dataset=dataset, model=model), root, "features", ("dataset", "model", "layer"))


def save_token_info(occurrence: DataFrame, root: str, dataset: str, model: str) -> None:
    """Long inverted index in token order, so that row groups can be skipped by token."""
    ordered = occurrence.repartitionByRange("token", "text_id").sortWithinPartitions("token", "text_id", "start")
    write_artifact(_keyed(ordered, dataset=dataset, model=model), root, "token_info", ("dataset", "model"))


def save_projection(projection: DataFrame, scores: DataFrame, root: str, dataset: str, model: str) -> None:
    """Rows with ``layer`` and ``method``; other data sets, models, layers and methods stay."""
    by = ("dataset", "model", "layer", "method")
    write_artifact(_keyed(projection, dataset=dataset, model=model), root, "projection", by)
    write_artifact(_keyed(scores, dataset=dataset, model=model), root, "projection_score", by)


def save_explanation(
    attribution: DataFrame, report: DataFrame, rows: DataFrame, root: str, dataset: str, model: str, layer: int
) -> None:
    """Rows with ``method``; other data sets, models, layers and methods stay."""
    by, keys = ("dataset", "model", "layer", "method"), {"dataset": dataset, "model": model, "layer": layer}
    for name, part in (("explanation", attribution), ("class_report", report), ("explanation_report", rows)):
        write_artifact(_keyed(part, **keys), root, name, by)


def stored_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """``dataset, model, layer, kind, method`` of what a store holds, read from its partitions."""
    shape = {"dataset": "string", "model": "string", "layer": "int", "kind": "string", "method": "string"}
    listed = spark.createDataFrame([], ", ".join(f"{name} {kind}" for name, kind in shape.items()))
    for name, kind in (("text", "text"), ("token_info", "token"), ("projection", "sentence"), ("explanation", "class")):
        try:
            rows = scan(spark, root, name)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        rows = rows.withColumn("kind", F.lit(kind))
        columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()]
        listed = listed.unionByName(rows.select(*columns).distinct())
    return listed


def scan(spark: SparkSession, root: str, name: str, **equals) -> DataFrame:
    """Read an artifact; conditions on partition columns prune folders."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    for column, value in equals.items():
        df = df.where(F.col(column) == value)
    return df
