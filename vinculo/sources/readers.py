"""Sources: typed and untyped CSV, JSON arrays and pages, Parquet, and checks on what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculo.functions.prefix import running
from vinculo.functions.runtime import materialize
from vinculo.sources.schemas import REGISTRY_PAGE, SCENARIOS, raw_schema


def read_raw(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """CSV with header and the entity's fixed schema; malformed numbers become null."""
    return spark.read.option("header", True).schema(raw_schema(entity)).csv(path)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_clean(spark: SparkSession, path: str, entity: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{entity}")


def read_registry_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, REGISTRY_PAGE)


def read_registry_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of landed registry pages, one row each, with the page files read in splits."""
    return read_json_records(spark, path, REGISTRY_PAGE.removeprefix("data array<").removesuffix(">"), depth=2)


def _attributes(landed: DataFrame) -> DataFrame:
    """The attributes of registry items, from pages or from items."""
    items = landed.select(F.explode("data").alias("d")).select("d.attributes") if "data" in landed.columns else landed
    return items.select("attributes.*")


def flatten_entities(pages: DataFrame) -> DataFrame:
    """One row per registry entity of pages or of items; an absent field is the empty text."""
    fields = {
        "lei": "lei", "legal_name": "entity.legalName.name", "status": "entity.status", "jurisdiction": "entity.jurisdiction", "registered_as": "entity.registeredAs",
        "legal_form_id": "entity.legalForm.id", "creation_date": "entity.creationDate", "address_city": "entity.legalAddress.city", "address_region": "entity.legalAddress.region",
        "address_country": "entity.legalAddress.country", "address_postal": "entity.legalAddress.postalCode",
    }
    each = _attributes(pages)
    return each.select(*[F.coalesce(F.col(path), F.lit("")).alias(name) for name, path in fields.items()])


def flatten_relationships(pages: DataFrame) -> DataFrame:
    """One row per registry edge from child to parent, of pages or of items."""
    fields = {"child_lei": "relationship.startNode.id", "parent_lei": "relationship.endNode.id", "rel_type": "relationship.type", "rel_status": "relationship.status", "valid_from": "validFrom", "valid_to": "validTo"}
    each = _attributes(pages)
    return each.select(*[F.coalesce(F.col(path), F.lit("")).alias(name) for name, path in fields.items()])


def filter_entities(entities: DataFrame, country: str = "MX", status: str = "ACTIVE") -> DataFrame:
    return entities.where((F.col("address_country") == country) & (F.col("status") == status))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, size_bytes) of all files below ``path``, from the store's own listing; no file is opened. An absent path has none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    if store.exists(root):
        files = store.listFiles(root, True)
        while files.hasNext():
            f = files.next()
            rows.append((f.getPath().getName(), f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(rows, "name string, path string, size_bytes long")


def check_sources(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """(name, size_bytes, found, expected): the expected files against those that are there; extra files are listed too."""
    files = list_files(spark, path).select("name", "size_bytes")
    want = spark.createDataFrame([(e,) for e in expected], "name string").withColumn("expected", F.lit(True))
    return want.join(files, "name", "full").select("name", "size_bytes", F.col("size_bytes").isNotNull().alias("found"), F.coalesce("expected", F.lit(False)).alias("expected"))


#: Rows of a JSON text that end with a closing brace; none but a brace ends one, so every split of a file is read by itself.
_BRACE = "}"


def read_json_records(spark: SparkSession, path: str, schema: str, depth: int = 1) -> DataFrame:
    """The objects at ``depth`` braces of JSON documents (1: the items of an array of objects, 2: those of an array inside an object), read in splits.

    A file is cut at closing braces wherever a split begins, so one large document is many tasks. Whether a piece begins
    inside a string, and at which depth, follows from running counts of quotes and braces over the pieces before it, which
    are prefix sums over range partitions; the pieces of an object then meet by its number. Objects come in any order;
    one that does not parse has null fields. Documents without such an object give no rows. Files are not compressed.
    """
    key = ["file", "block", "at"]
    source = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    text = materialize(spark.read.option("lineSep", _BRACE).text(path).select(*source, F.monotonically_increasing_id().alias("at"), "value"))
    bare = F.regexp_replace("value", r"\\.", "")
    number_of = lambda c, sign: (F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))).cast("bigint")
    odd = running(text.select(*key, number_of(bare, '"').alias("q")), key[1:], ["q"], ["file"])
    rows = text.join(odd.select(*key, F.pmod(F.col("q_upto") - F.col("q"), F.lit(2)).alias("inside"), F.pmod("q_upto", F.lit(2)).alias("ends_inside")), key)
    code = F.regexp_replace(F.concat(F.when(F.col("inside") == 1, '"').otherwise(""), bare), r'"[^"]*("|$)', "")
    shut = F.col("ends_inside") == 0
    rows = materialize(rows.select(*key, "value", (number_of(code, "{") - shut.cast("bigint")).alias("net"), shut.alias("shut")), text)
    level = running(rows.select(*key, "net", "shut"), key[1:], ["net"], ["file"])
    # a closing brace that comes back to depth - 1 ends an object, one that comes below ends what holds objects
    level = level.select(*key, (F.col("net_upto") - F.col("net")).alias("level"), (F.col("shut") & (F.col("net_upto") == depth - 1)).alias("done"), (F.col("shut") & (F.col("net_upto") < depth)).cast("bigint").alias("ends"))
    number = running(level, key[1:], ["ends"], ["file"]).select(*key, "level", "done", (F.col("ends_upto") - F.col("ends")).alias("number"))
    pieces = rows.select(*key, "value").join(number, key).groupBy("file", "number")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: F.concat(x["value"], F.lit(_BRACE))), "")
    whole = pieces.agg(F.max("done").alias("done"), F.min_by("level", F.struct("block", "at")).alias("level"), joined.alias("json")).where("done")
    # the object begins at the brace that leads to its depth; before it stand separators and, once, the openings of what holds it
    body = F.col("json")
    for n in range(1, depth + 1):
        skipped = r'^(?:(?:[^"{]|"(?:[^"\\]|\\.)*+")*+\{){' + str(n) + "}"
        body = F.when(F.col("level") == depth - n, F.regexp_replace("json", skipped, "{")).otherwise(body)
    return whole.select(F.from_json(body, schema).alias("x")).select("x.*")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or an error that names the absent columns."""
    if absent := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"required columns are absent: {', '.join(absent)}")
    return df


def read_scenarios(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, edges, loans and stored metrics of a scenario document, one table each."""
    each = read_json_array(spark, path, SCENARIOS).select(F.explode("scenarios").alias("s"))
    out = {part: each.select(F.col("s.id").alias("scenario"), F.explode(f"s.{part}").alias("x")).select("scenario", "x.*") for part in ("nodes", "edges", "loans")}
    return out | {"metrics": each.select(F.col("s.id").alias("scenario"), "s.metrics.*")}
