"""Secret scan with corpus-wide ownership frequency (operator 9), DataFrame functions only.

Base kinds are found by fixed patterns, leftmost and non-overlapping per kind. The method adds spans
of kind ``token``: long mixed strings outside every base span. All candidates are hashed, and the
hashes are counted by distinct repositories and distinct owners over the whole corpus. A candidate
that more than ``max_owners`` owners or more than ``max_repositories`` repositories have is a widely
copied example; one that is confined to few and looks live (no placeholder word, several different
characters) is a credential.

Matches are exploded and their places summed in windows, so a text of many matches costs a sort of
them. Most texts have none, and are passed over by one pattern and some plain searches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import restored, sheltered, staged, text_of

_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
KEYWORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
#: kind, pattern, and the group that is measured and hashed. Runs of one class are asked for at full
#: length, from their first character: a shorter run can't hold a longer match.
ASSIGN = "(" + KEYWORDS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+"
KINDS = (("assign", ASSIGN, 2), ("access", "AKIA[A-Z0-9]{16,}", 0), ("hex", "(?<![0-9a-f])[0-9a-f]{24,}+", 0), ("token", LONG, 0))
MIN_ASSIGN = 6
BASE = ("assign", "access", "hex")
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0000000|1234567|abcdefg"


def _holds(text: Column) -> dict[str, Column]:
    """Of each kind a cheap condition that every text with a match meets."""
    low = F.lower(text)
    word = lambda *words: F.array_max(F.array(*(F.contains(low, F.lit(w)) for w in words)))
    return {
        "assign": word("password", "passwd", "secret", "token", "apikey", "api_key"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike(LONG),  # every long run of hexadecimal digits lies within one
        "token": text.rlike(LONG),
    }


def _matches(text: Column, order: int, kind: str, pattern: str, group: int, holds: Column) -> Column:
    """Array of (kind_order, kind, nth, gap, length, measured, mixed, hash, looks_live): ``gap`` is what lies before a match since the last one."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    looks_live = lambda v: ~v.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(v, ""))) >= 8)

    def match(x, i):
        v = x["value"]
        measured = F.length(v) >= (MIN_ASSIGN if group else 1)
        mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
        # Values are kept as digests only: the scratch table holds no secret.
        return F.struct(
            F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), F.length(x["hit"]).alias("length"),
            measured.alias("measured"), mixed.alias("mixed"), F.md5(v.cast("binary")).alias("hash"), looks_live(v).alias("looks_live"),
        )

    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    return F.when(holds, F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), match))


def _scanned(docs: DataFrame, text: str, owner: str, repository: str, keep: list[Column]) -> DataFrame:
    """``keep`` of each row, its number, owner and repository, and its matches (null if none)."""
    t = text_of(text)
    holds = _holds(t)
    none = F.array().cast("array<struct<kind_order:int,kind:string,nth:int,gap:int,length:int,measured:boolean,mixed:boolean,hash:string,looks_live:boolean>>")
    every = F.concat(*(F.coalesce(_matches(t, i, *k, holds[k[0]]), none) for i, k in enumerate(KINDS)))
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    found = F.when(F.reduce(F.array(*holds.values()), F.lit(False), lambda a, b: a | b), every)
    rows = docs.select(*keep, own(owner).alias("owner_"), own(repository).alias("repository_"), found.alias("matches_"), F.monotonically_increasing_id().alias("row"))
    return staged(rows, "secrets")


def _judged(scanned: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """A row per span that counts: row, start, kind_order, kind, end, owners, repositories, live."""
    each = scanned.select("row", "owner_", "repository_", F.explode("matches_").alias("x")).select("row", "owner_", "repository_", "x.*")
    in_kind = Window.partitionBy("row", "kind_order").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("length")).over(in_kind.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    is_base = F.col("kind").isin(*BASE)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).where("measured").where(is_base | F.col("mixed"))
    # A token counts if every base span that starts before its end ends before its start.
    sweep = Window.partitionBy("row").orderBy(F.when(is_base, F.col("start")).otherwise(F.col("end")), is_base.cast("int"))
    reach = F.max(F.when(is_base, F.col("end"))).over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("reach", reach).where(is_base | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    each = staged(each.select("row", "owner_", "repository_", "start", "kind_order", "kind", "end", "hash", "looks_live"), "candidates")
    by_repository = each.groupBy("hash", "owner_", "repository_").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("hash", "owner_").agg(F.sum("one").alias("repositories"))
    spread = staged(by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")), "spread")
    live = F.col("looks_live") & (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = each.join(spread, "hash").withColumn("live", live).where(is_base | F.col("live"))
    return judged.select("row", *SPAN)


SPAN = ["start", "kind_order", "kind", "end", "owners", "repositories", "live"]
MOST_OWNERS, MOST_REPOSITORIES = 2, 10


def find_secrets(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MOST_OWNERS, max_repositories: int = MOST_REPOSITORIES
) -> DataFrame:
    """One row per row of ``docs``: its columns without the text, and

    - ``base``: array of (start, kind_order, kind, end), the fixed kinds, by start and then kind;
    - ``spans``: the same plus the method's spans, each with ``owners``, ``repositories``, ``live``.

    A null text counts as empty and has no spans. Rows with a null owner share one owner, rows with a
    null repository one repository. Repeated rows are each reported. An empty table gives an empty one.
    An extra column that clashes with a name added here (base, spans) is dropped.
    """
    keep = [c for c in docs.columns if c not in (text, "base", "spans", "row", "owner_", "repository_", "matches_")]
    scanned = _scanned(docs, text, owner, repository, [F.col(f"`{c}`") for c in keep])
    judged = _judged(scanned, max_owners, max_repositories)
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*SPAN))).alias("spans"))
    out = scanned.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind_order"].alias("kind_order"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda x: x["kind"].isin(*BASE)), bare)
    return out.select(*(F.col(f"`{c}`") for c in keep), base.alias("base"), "spans")


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of query op9."""
    out = find_secrets(docs.select("doc_id", "source", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_examples"),
    )


def _piece(blocks: Column, low: Column, high: Column) -> Column:
    """The code points from low to high of a text in blocks of ``BLOCK``: never walks the whole text."""
    first, last = F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    head = F.substring(block(first), (low % BLOCK + 1).cast("int"), F.when(first == last, high - low).otherwise(F.lit(BLOCK)).cast("int"))
    between = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
    rest = F.when(first == last, "").otherwise(F.concat(F.when(last - first > 1, between).otherwise(""), F.substring(block(last), F.lit(1), (high % BLOCK).cast("int"))))
    return F.when(low < high, F.concat(head, rest)).otherwise("")


BLOCK = 1024


def redact_secrets(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MOST_OWNERS, max_repositories: int = MOST_REPOSITORIES
) -> DataFrame:
    """``docs`` with each maximal run of overlapping spans replaced by ``<SECRET>``; every row stays.

    ``n_chars``, if there, is counted anew where a text changes. A null text stays null, null owners
    and ids count as one each, repeated rows are each redacted, clashing columns are kept as they are,
    and an empty table gives an empty one.
    """
    rows, names = sheltered(docs)
    text, n_chars = names[text], names.get("n_chars")
    scanned = _scanned(rows, text, names[owner], names[repository], [F.col(c) for c in rows.columns])
    judged = _judged(scanned, max_owners, max_repositories).select("row", "start", "end")
    in_row = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    judged = judged.withColumn("fresh", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    judged = judged.withColumn("run", F.sum("fresh").over(in_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = judged.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = staged(runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs_")), "runs")
    done = scanned.drop("matches_", "owner_", "repository_").join(runs, "row", "left")
    done = done.withColumn("blocks_", F.when(F.col("runs_").isNotNull(), F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    blocks = F.col("blocks_")
    before = lambda x, i: F.concat(_piece(blocks, F.when(i > 0, F.get("runs_", i - 1)["end"]).otherwise(0), x["start"]), F.lit("<SECRET>"))
    cut = F.concat(F.array_join(F.transform("runs_", before), ""), _piece(blocks, F.element_at("runs_", -1)["end"], F.length(text)))
    done = done.withColumn("cut_", F.when(F.col("runs_").isNotNull(), cut))
    if n_chars:
        done = done.withColumn(n_chars, F.when(F.col("runs_").isNull(), F.col(n_chars)).otherwise(F.length("cut_").cast("long")))
    return done.withColumn(text, F.when(F.col("runs_").isNull(), F.col(text)).otherwise(F.col("cut_"))).select(*restored(names))
