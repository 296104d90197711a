"""Secret scans with corpus-wide ownership, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.llm.common import only, query, row_key, sha, stored, table

# fixed values: the kinds in order, the pattern, the group that holds the value, its least length.
# Runs of one class match greedily, so a least length inside the pattern drops the same matches as a
# check afterwards; for `assign` it would not, and its length is checked on the match.
KINDS = {
    "assign": (
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
ADDED = "owned"


def _bound(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body looks at it."""
    return F.transform(F.array(value), body)[0]


def _sums(values: Column) -> Column:
    """Running sums. Lists grow by copies, so the work grows with the square of the length."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + x
        return F.struct(at.alias("at"), F.concat(state["all"], F.array(at)).alias("all"))

    return F.aggregate(values, start, step, lambda state: state["all"])


def running(values: Column) -> Column:
    """Running sums of an array of int, as array<int>.

    The array is cut into about as many slices as a slice has values; sums inside slices and sums of
    slices are short lists, so n values take about n to the power of 1.5 copies.
    """

    def sliced(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        firsts = F.sequence(F.lit(1), F.size(v), width)
        return F.transform(firsts, lambda first: _sums(F.slice(v, first, width)))

    def joined(inner: Column) -> Column:
        lasts = _sums(F.transform(inner, lambda x: F.element_at(x, -1)))
        before = F.concat(F.array(F.lit(0)), lasts)
        return _bound(
            before,
            lambda b: F.flatten(F.transform(inner, lambda x, i: F.transform(x, lambda y: y + b[i]))),
        )

    none = F.array().cast("array<int>")
    return _bound(values, lambda v: F.when(F.size(v) > 0, _bound(sliced(v), joined)).otherwise(none))


def _spans(text: Column, kind: str) -> Column:
    """Array of (start, kind, end, value, value_end) of one kind.

    Text between matches and the matches themselves alternate, so running sums of their lengths give
    all places.
    """
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(hits: Column) -> Column:
        # one more gap than matches: its length has no partner and goes
        steps = F.zip_with(gaps, hits, lambda gap, hit: F.length(gap) + F.length(hit))
        sized = F.zip_with(
            hits, values, lambda hit, value: F.struct(F.length(hit).alias("n"), value.alias("value"))
        )
        every = F.zip_with(
            running(F.filter(steps, lambda x: x.isNotNull())),
            sized,
            lambda end, x: F.struct(
                (end - x["n"]).alias("start"),
                F.lit(rank).alias("kind"),
                end.alias("end"),
                x["value"].alias("value"),
                end.alias("value_end"),
            ),
        )
        return F.filter(every, lambda x: F.length(x["value"]) >= least)

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,value_end:int>>")
    return F.when(text.rlike(pattern), _bound(whole, placed)).otherwise(none)


def base_spans(
    docs: DataFrame, doc_id: str, text: str, owner: str, repository: str
) -> DataFrame:
    """Base spans of every row, sorted by start, then kind. Null text: no spans."""
    rows = only(docs, doc_id=doc_id, text=text, owner=owner, repository=repository)
    rows = rows.select(
        F.col("doc_id").cast("long"),
        *row_key(),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("owner").cast("string"),
        F.col("repository").cast("string"),
    )
    said = F.col("text")
    spans = F.array_sort(F.concat(*[_spans(said, k) for k in KINDS]))
    return rows.select("doc_id", "_id", "_h", "owner", "repository", spans.alias("base"))


def ownership(base: DataFrame) -> DataFrame:
    """Per candidate value (as a hash): distinct owners and repositories, and whether it looks live.

    Distinct (value, owner) and (value, repository) pairs are combined before they are counted, so a
    value copied into a third of the corpus reaches no task as single rows. A null owner or repository
    counts as one more.
    """
    hits = base.select("owner", "repository", F.explode("base").alias("s")).select(
        F.sha2("s.value", 256).alias("value_hash"),
        "owner",
        "repository",
        looks_live(F.col("s.value")).alias("live"),
    )
    pairs = F.array(
        F.struct(F.lit(0).alias("side"), F.col("owner").alias("name")),
        F.struct(F.lit(1).alias("side"), F.col("repository").alias("name")),
    )
    distinct = (
        hits.select("value_hash", "live", F.explode(pairs).alias("p"))
        .groupBy("value_hash", "live", "p.side", "p.name")
        .agg(F.count("*").alias("n"))
    )
    count = lambda side, what: F.sum(F.when(F.col("side") == side, what).otherwise(0))
    return distinct.groupBy("value_hash", "live").agg(
        count(0, 1).alias("n_owners"),
        count(1, 1).alias("n_repositories"),
        count(0, F.col("n")).alias("n_spans"),
    )


def looks_live(value: Column) -> Column:
    """Letters and digits mixed, and more than a few different characters: not a word, not a filler."""
    letters = F.array_distinct(F.split(value, ""))
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.size(letters) >= 8)


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    max_owners: int = 1,
    max_repositories: int = 10,
) -> DataFrame:
    """Per row: (doc_id, base, owned), spans as arrays of structs.

    `owned` repeats the value of each base span whose value looks live and is found with at most
    `max_owners` owners and in at most `max_repositories` repositories of the whole corpus. Values copied
    between owners, or through many repositories of one owner, are examples and are not repeated.
    Offsets are code points, ends exclusive.

    Null or empty text: no spans. A null owner is an owner of its own. Rows that repeat in full count
    once per repetition in n_spans and give equal results. An empty table gives no rows.
    """
    base = stored(base_spans(docs, doc_id, text, owner, repository), "secrets")
    owned = (
        ownership(base)
        .where(F.col("live") & (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
        .select("value_hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salt = F.pmod(F.xxhash64("_id", "_h"), F.lit(SALTS)).cast("int")
    hits = base.select("_id", "_h", salt.alias("salt"), F.explode("base").alias("s"))
    hits = hits.withColumn("value_hash", F.sha2("s.value", 256))
    span = F.struct(
        (F.col("s.end") - F.length("s.value")).alias("start"), F.col("s.end").alias("end")
    )
    per_doc = (
        hits.join(owned, ["value_hash", "salt"], "left_semi")
        .groupBy("_id", "_h")
        .agg(F.array_sort(F.collect_set(span)).alias("owned"))
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return base.join(per_doc, ["_id", "_h"], "left").select(
        "doc_id", "base", F.coalesce("owned", none).alias("owned")
    )


#: Rows of one value are spread over this many parts before they meet its verdict.
SALTS = 32


def _listed(spans: Column) -> Column:
    """kind:start:end in order of start, then kind."""
    names = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    texts = F.transform(
        spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(texts, ",")


@query("op7_secrets")
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, base spans and those of values with one owner."""
    found = scan(table(spark, folder, "documents"))
    plain = F.transform(
        "base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    )
    added = F.transform(
        "owned",
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")
        ),
    )
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        sha(_listed(plain)).alias("base_sha256"),
        _listed(F.array_sort(F.concat(plain, added))).alias("spans"),
    )
