"""Sources and sinks: configuration JSON, JSON lines, CSV, plain lines, documents as files, tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.dialect import let, strip, words
from corvane.operators import detect

RULE_SCHEMA = (
    "id string, name string, pattern string, description string, severity string, threat_type string, scope string, redact boolean, exceptions array<string>, tags array<string>, "
    "enabled boolean, status string, source string, support int, workspace_id string, approval_status string, approval_requested_by string, approval_approved_by string"
)
FEED_SCHEMA = "version string, updated_at string, entries array<struct<id:string,name:string,pattern:string,category:string,severity:string,scope:string,description:string,source:string,tags:array<string>,enabled:boolean,updated_at:string>>"
LONGEST = 100_000


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Custom rules, with the defaults of absent fields."""
    d = spark.read.schema(RULE_SCHEMA).json(path, multiLine=True)
    fall = {"severity": "LOW", "threat_type": "CUSTOM_RULE", "scope": "both", "redact": False, "enabled": True, "status": "active", "workspace_id": "global", "approval_status": "not_requested"}
    return d.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fall.items()})


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Signatures of a threat feed; where its entries are no list, the seed signatures."""
    d = spark.read.schema(FEED_SCHEMA).json(path, multiLine=True).select(F.col("entries"))
    seed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in vars(s).items()], F.lit("seed").alias("source")) for s in detect.SEED_SIGNATURES])
    kind = d.schema["entries"].dataType.elementType
    seeds = F.transform(seed, lambda x: F.struct(*[(x[f.name] if f.name in SEED_FIELDS else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind]))
    return d.select(F.explode(F.coalesce("entries", seeds)).alias("e")).select("e.*")


SEED_FIELDS = ("id", "name", "pattern", "category", "severity", "scope", "enabled", "source")


PRESET_SCHEMA = "name string, description string, action_overrides map<string,map<string,string>>, session_flag_threshold double, session_block_threshold double, allowlist_patterns array<string>, allowlist_max_severity string, detector_thresholds map<string,map<string,double>>, enabled boolean, status string, workspace_id string"


def presets(spark: SparkSession, path: str) -> DataFrame:
    """Custom presets, with the defaults of absent fields."""
    d = spark.read.schema(PRESET_SCHEMA).json(path, multiLine=True)
    fall = {"session_flag_threshold": 8.0, "session_block_threshold": 12.0, "allowlist_max_severity": "LOW", "enabled": True, "status": "active", "workspace_id": "global"}
    return d.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fall.items()})


def workspaces(spark: SparkSession, path: str) -> DataFrame:
    """Workspaces by name, whatever its case."""
    return spark.read.schema("id string, name string, description string").json(path, multiLine=True).orderBy(F.lower("name"), "name")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    d = spark.read.csv(path, header=True, multiLine=True).select(strip(F.col(column)).alias("text"))
    return d.filter(F.col("text") != "")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("text")).filter(F.col("text") != "")


#: A cell of CSV text (quotes double inside quotes; text may follow the closing one) and what ends it.
CSV_CELL = r'(?:"([^"]*+(?:""[^"]*+)*+)"?)?([^,\r\n]*+)(,|\r\n|\n|\r|\z)'


def csv_cells(text: Column) -> Column:
    """Non-empty cells of CSV text joined by bars, rows by line ends; quoted cells may hold commas and line ends."""
    part = lambda g: F.regexp_extract_all(text, F.lit(CSV_CELL), F.lit(g))
    # the match at the very end of the text is an empty cell of no row
    cells = F.transform(F.arrays_zip(part(1).alias("q"), part(2).alias("p"), part(3).alias("e")), lambda x: F.struct(strip(F.concat(F.replace(x["q"], F.lit('""'), F.lit('"')), x["p"])).alias("v"), x["e"].alias("e")))

    def rows(c: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: F.get(c, i - 1)["e"] != ",")

        def joined(at: Column) -> Column:
            one = lambda i, k: F.array_join(F.filter(F.transform(F.slice(c, F.coalesce(F.get(at, k - 1), F.lit(0)) + 1, i - F.coalesce(F.get(at, k - 1), F.lit(0))), lambda x: x["v"]), lambda v: v != ""), " | ")
            return F.array_join(F.filter(F.transform(at, one), lambda r: r != ""), "\n")

        return let(ends, joined)

    return F.when(text == "", "").otherwise(let(cells, rows))


#: Kinds of files. Then what is said of extracted text.
TEXT_KINDS = (".txt", ".md", ".json", ".log", ".html", ".xml", ".yaml", ".yml")
IMAGE_KINDS = (".png", ".jpg", ".jpeg")
SHORT, LOW = "The file gave hardly any text.", "Much of the text looks damaged; read it before you rely on the decision."
NOISY, STRUCTURE = "Text recognised in a picture may hold wrong letters.", "Text of a PDF may be out of order."


def warnings(text: Column, quality_: Column, suffix: Column) -> Column:
    said = {
        SHORT: F.length(strip(F.coalesce(text, F.lit("")))) < 20,
        LOW: quality_ == "low",
        NOISY: suffix.isin(*IMAGE_KINDS),
        STRUCTURE: suffix == ".pdf",
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(w)) for w, c in said.items()]))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, text, oversize, mode, quality, warnings`` of files, whole (``oversize`` says that a text has more than ``LONGEST`` characters): text family decoded as UTF-8, else UTF-16, else Latin-1; CSV as joined cells.

    PDF and image readers are optional libraries that are not part of this package; such files get a null text.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = None
                if not name.lower().endswith((".pdf", ".png", ".jpg", ".jpeg")):
                    for code in ("utf-8", "utf-16", "latin-1"):
                        try:
                            text = raw.decode(code)
                            break
                        except UnicodeDecodeError:
                            continue
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "text"])

    d = files.mapInArrow(decode, "path string, text string").withColumn("name", F.element_at(F.split("path", "/"), -1))
    suffix = F.lower(F.regexp_extract("name", r"\.[^.]+$", 0))
    text = F.when(suffix == ".csv", csv_cells(F.col("text"))).otherwise(F.col("text"))
    d = d.select("path", "name", suffix.alias("_kind"), text.alias("text"), (F.length(text) > LONGEST).alias("oversize"))
    mode = F.when(F.col("_kind").isin(*IMAGE_KINDS), "ocr").when(F.col("_kind") == ".pdf", "pdf").when(F.col("_kind") == ".csv", "csv").otherwise("text")
    d = d.withColumn("mode", mode).withColumn("quality", quality(F.col("text"), F.col("_kind")))
    return d.withColumn("warnings", warnings(F.col("text"), F.col("quality"), F.col("_kind"))).drop("_kind")


def quality(text: Column, suffix: Column | str = "") -> Column:
    """Extraction quality: share of odd characters, shortness, single-letter tokens."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    plain = strip(F.coalesce(text, F.lit("")))
    odd = F.length(F.regexp_replace(plain, r"""(?U)[\p{L}\p{N}\s.,:;!?\-_/@#()\[\]'"]+""", "")) / F.greatest(F.length(plain), F.lit(1))
    short = F.length(plain) < 30
    tokens = words(plain)
    single = F.size(F.filter(tokens, lambda t: F.length(t) == 1)) > F.greatest(F.lit(5), F.floor(F.size(tokens) / 2))
    image = F.when((odd > 0.2) | single | short, "low").when(odd > 0.08, "medium").otherwise("high")
    pdf = F.when((odd > 0.15) | short, "low").when(odd > 0.06, "medium").otherwise("medium")
    return F.when(plain == "", "low").when(suffix.isin(".png", ".jpg", ".jpeg"), image).when(suffix == ".pdf", pdf).otherwise("high")


def base64_text(body: Column) -> Column:
    return F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8")


def save(df: DataFrame, path: str, form: str = "parquet", mode: str = "append", *partition_by: str) -> None:
    """Appends decisions, audit rows or reports as parquet, json or csv; ``markdown`` writes a column
    ``markdown`` as text files."""
    if form == "markdown":
        df, form = df.select("markdown"), "text"
    writer = df.write.mode(mode).format(form)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
