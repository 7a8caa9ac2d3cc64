"""Secrets: patterns propose spans, and who else holds the same value tells copied examples from live ones."""

from pyspark.sql import Column, DataFrame, functions as F

from hoplens.llm import spans
from hoplens.llm.common import cut, whole_text

# The shapes proposed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PEM_BEGIN, PEM_END = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----END [A-Z ]{0,40}PRIVATE KEY-----"
#: A private key from its first line to its last; the first alone where no last one comes before another line of dashes.
PEM = f"{PEM_BEGIN}(?:[^-]*+(?:-(?!----)[^-]*+)*+{PEM_END})?+"
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{32,}+",
    "github": "gh[pousr]_[A-Za-z0-9]{36,}+",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
    "pem": PEM,
}
BASE = ("assign", "access", "hex")
#: A value in this many owners' hands is an example that people copy, not a live credential.
EXAMPLE_OWNERS = 3
#: Bounds of the lengths that the base kinds ask for.
ASSIGN_LEAST, ACCESS_LEAST = 8, 16


def _secret(kind: Column, value: Column) -> Column:
    """The secret itself: without the name it is assigned to, a private key without its lines of dashes and white space. A key of which
    only the first line is there has none."""
    key = F.regexp_replace(F.regexp_replace(value, f"^{PEM_BEGIN}|{PEM_END}$", ""), r"\s+", "")
    return F.when(kind == "assign", F.regexp_extract(value, ASSIGN, 2)).when(kind == "pem", key).otherwise(value)


def _long_enough(kind: str, value: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(value, ASSIGN, 2)) >= ASSIGN_LEAST
    return F.length(value) >= ACCESS_LEAST if kind == "access" else F.lit(True)


def _need(kind: str, text: Column) -> Column:
    if kind == "assign":
        return text.contains(":") | text.contains("=")
    sign = {"access": "AKIA", "github": "gh", "jwt": "eyJ", "pem": "-----BEGIN "}.get(kind)
    return text.contains(sign) if sign else text.rlike("[0-9a-f]{32}")


def find_secrets(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """Secrets of every row, each with how many hold the same value.

    Returns ``doc_id`` and ``found``, an array of ``start, end, kind, value, repositories, owners, example, base`` by start and
    kind, one row per input row; columns beside ``doc_id``, ``text``, ``repository`` and ``owner`` are not read. A value is
    counted over the whole corpus by its digest: first by digest and holder, so that a value that a third of all rows repeat
    is added up before it is shuffled. A null repository or owner counts as one more. A null text counts as empty; repeated
    rows are searched each.
    """
    text = whole_text()
    every = [
        spans.find(text, pattern, kind, rank, lambda value, kind=kind: _long_enough(kind, value), _need(kind, text))
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
    ]
    found = F.transform(
        spans.in_order(*every),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["rank"].alias("rank"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
            _secret(s["kind"], s["value"]).alias("value"),
        ),
    )
    holder = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("\u0000"))
    rows = cut(
        docs.select(
            F.col("doc_id").alias("doc_id"),
            holder(repository).alias("repository"),
            holder(owner).alias("owner"),
            found.alias("spans"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    each = rows.select("row", "repository", "owner", F.explode("spans").alias("span")).withColumn(
        # What has no secret in it is no copy of anything.
        "digest",
        F.when(F.col("span.value") == "", F.concat_ws(":", "row", "span.start")).otherwise(F.sha2(F.col("span.value"), 256)),
    )
    held = (
        each.groupBy("digest", "repository", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("digest")
        .agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    )
    told = F.struct(
        F.col("span.start").alias("start"),
        F.col("span.rank").alias("rank"),
        F.col("span.end").alias("end"),
        F.col("span.kind").alias("kind"),
        F.col("span.value").alias("value"),
        "repositories",
        "owners",
        (F.col("owners") >= EXAMPLE_OWNERS).alias("example"),
        F.col("span.kind").isin(*BASE).alias("base"),
    )
    by_row = each.join(held, "digest").groupBy("row").agg(F.array_sort(F.collect_list(told)).alias("told"))
    none = F.array().cast(by_row.schema["told"].dataType)
    return rows.join(by_row, "row", "left").select("doc_id", F.coalesce("told", none).alias("found"))
