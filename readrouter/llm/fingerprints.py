"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame and SQL functions only.

A paragraph (line) is cut into runs of at most `unit_words` words; the digest of a run and its number among equal runs of the
text is an element. Elements are dealt to shards by their low bits, a power of two of them, so that at most about SHARD_ELEMENTS
elements of a text meet in one, and within a shard to one cell of each of three parts. A cell holds the number of its
elements, the exclusive or of their digests and of check values. The cells of two texts subtract, both with the shards of
the longer one, as an element keeps its cell for any number of shards. In the difference, a cell of one element gives its digest, which is
removed from its other cells, and so on (peeling), until all differing digests are known. A shard that does not peel is
sketched again from both texts with four times the cells and other hashes, until it peels; nothing is estimated.

Likeness is the share of elements in common: (n - d) / (n + d), with n the elements of both texts and d the digests recovered.
`differences` returns those digests.

Sketches of a text, of its edited text and of the next text share rows where their shards are as many. Everything runs on one shuffle
of the texts: documents are dealt by ranges of ids, and the first of each range also goes to the range before.

Defined results: null text counts as empty; two texts without words are alike (1); the text after the last id is that of the first; with one document it
follows itself; rows that repeat an id must repeat its text, and follow as one; a row with a null id has no place in the order and
gets no fingerprint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_ids, partitions, sized, stage

UNIT_WORDS, SHARD_ELEMENTS = 12, 8
#: Cells in each of the three parts of a shard.
PART = 16
#: Each retry leaves a small share of its shards, so that the last is never reached; a shard that it leaves is an error.
RETRIES, ROUNDS = 12, 10
#: Ranges of ids for each shuffle partition.
RANGES = 4
#: What rows are sketched for: text with all that has its number of shards, edited text alone, text with edited text, text with next text.
ALL, EDITED, WITH_EDITED, WITH_NEXT = range(4)


def _bounds(ids: DataFrame, n: int) -> list[int]:
    """Cut points that deal the ids into about n ranges; as many as there are shuffle partitions, whatever the rows."""
    if n < 2:
        return []
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    return sorted(set(found or []))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of cut points up to the id, found in two steps."""
    if not bounds:
        return F.lit(0).cast("bigint")
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads, nested = F.lit([g[0] for g in groups]).cast("array<bigint>"), F.array(*(F.lit(g).cast("array<bigint>") for g in groups))
    group = F.size(F.filter(heads, lambda c: c <= doc_id))
    within = F.size(F.filter(F.element_at(nested, F.greatest(group, F.lit(1))), lambda c: c <= doc_id))
    return F.when(group == 0, 0).otherwise((group - 1) * step + within).cast("bigint")


def with_next(documents: DataFrame) -> DataFrame:
    """bucket, _copy, doc_id, text, next_text of every distinct id, by one shuffle; at the end of a bucket the first document of the next one, as a copy."""
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _bounds(docs.select("doc_id"), RANGES * partitions(docs.sparkSession))
    dealt = docs.withColumn("bucket", _range_of(F.col("doc_id"), bounds))
    heads = sorted((r["bucket"], r["id"]) for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("id")).collect())  # one for each range
    before = [(i, heads[k - 1][0]) for k, (_, i) in enumerate(heads)]
    copies = dealt.join(F.broadcast(docs.sparkSession.createDataFrame(before, "doc_id bigint, _to bigint")), "doc_id")
    copies = copies.dropDuplicates(["doc_id"]).select("doc_id", "text", F.col("_to").alias("bucket"), F.lit(1).alias("_copy"))
    # Rows grow tenfold from here on, so the number of partitions must not follow the size of the texts.
    rows = dealt.withColumn("_copy", F.lit(0)).unionByName(copies).repartition(RANGES * partitions(docs.sparkSession), "bucket")
    rows = rows.withColumn("_again", F.lag("doc_id").over(_in_order()).eqNullSafe(F.col("doc_id")) & F.lag("_copy").over(_in_order()).eqNullSafe(F.col("_copy"))).where("not _again")
    return rows.select("bucket", "_copy", "doc_id", "text", F.lead("text").over(_in_order()).alias("next_text"))


def _in_order():
    return Window.partitionBy("bucket").orderBy("_copy", "doc_id")


def _units(text: Column, unit_words: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\S+(?:[^\S\n]+\S+){{0,{unit_words - 1}}}"), F.lit(0))


def _shards(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)) / F.lit(float(SHARD_ELEMENTS)))), F.lit(0))).cast("int")


def _edit(text: Column, following: Column) -> Column:
    n = F.length(text)
    take = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - take), F.substring(following, F.lit(1), take))


def _check(digest: str, salt: int) -> str:
    return f"(hash({digest}, {77 + salt}) & 65535)"


def _cell(digest: str, part: str, width: int, salt: int) -> str:
    return f"({part} * {width} + pmod(hash({digest}, {5 + salt}, {part}), {width}))"


def _peeled(cells: str, width: int, salt: int) -> str:
    """struct<c: cells left, ids: digests found, each with its side as 1 or -1> of the cells of a difference."""
    part = f"cast(x.idx div {width} as int)"
    places = ", ".join(f"'p{i}', {_cell('x.id', str(i), width, salt)}" for i in range(3))
    known = f"filter(s.c, x -> abs(x.cnt) = 1 and x.chk = {_check('x.id', salt)} and {_cell('x.id', part, width, salt)} = x.idx)"
    # The cells of a digest are found once, when it is; a cell then only compares numbers.
    pure = f"transform(array_distinct(transform({known}, x -> named_struct('id', x.id, 'cnt', x.cnt, 'chk', x.chk))), x -> named_struct('id', x.id, 'cnt', x.cnt, 'chk', x.chk, {places}))"
    less = "aggregate(filter(p, q -> q.p0 = x.idx or q.p1 = x.idx or q.p2 = x.idx), x, (a, q) -> named_struct('idx', a.idx, 'cnt', a.cnt - q.cnt, 'id', a.id ^ q.id, 'chk', a.chk ^ q.chk))"
    step = f"transform(array({pure}), p -> if(size(p) = 0, s, named_struct('c', filter(transform(s.c, x -> {less}), x -> x.cnt <> 0 or x.id <> 0 or x.chk <> 0), 'ids', concat(s.ids, transform(p, q -> named_struct('id', q.id, 'cnt', q.cnt))))))[0]"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('c', {cells}, 'ids', cast(array() as array<struct<id:bigint,cnt:int>>)), (s, r) -> if(size(s.c) = 0, s, {step}))"


def _difference(a: int, b: int) -> str:
    """The cells of side a less those of side b, without those that cancel out."""
    return f"filter(transform(cells, x -> named_struct('idx', x.idx, 'cnt', x.c{a} - x.c{b}, 'id', x.i{a} ^ x.i{b}, 'chk', x.k{a} ^ x.k{b})), x -> x.cnt <> 0 or x.id <> 0 or x.chk <> 0)"


def _print(side: int) -> Column:
    """The cells of one side as text: place, count and check in 8 digits, and the digests in 16, after a digit that keeps their zeros."""
    own = F.filter("cells", lambda c: (c[f"c{side}"] != 0) | (c[f"i{side}"] != 0))
    small = lambda c: F.shiftleft(F.lit(1).cast("bigint"), 36) + F.shiftleft(c["idx"].cast("bigint"), 24) + F.shiftleft(c[f"c{side}"].cast("bigint"), 16) + c[f"k{side}"]
    return F.concat(F.lpad(F.hex("shard"), 4, "0"), F.array_join(F.transform(own, lambda c: F.concat(F.hex(small(c)), F.lpad(F.hex(c[f"i{side}"]), 16, "0"))), ""))


def _numbered(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d, the digest, and in, a bit for each of two sides that hold it, of every element; rows of a null unit stay, with a null d."""
    hashed = units.select(*keys, "side", F.when(F.col("_unit").isNotNull(), F.xxhash64("_unit")).alias("_h"))
    of = lambda side: F.sum(F.when(F.col("side") == side, 1).otherwise(0)).cast("int").alias(f"_c{side}")
    counted = hashed.groupBy(*keys, "_h").agg(of(0), of(1)).withColumn("_o", F.explode(F.sequence(F.lit(1), F.greatest("_c0", "_c1", F.lit(1)))))
    held = (F.when(F.col("_o") <= F.col("_c0"), 1).otherwise(0) + F.when(F.col("_o") <= F.col("_c1"), 2).otherwise(0)).alias("in")
    return counted.select(*keys, held, F.when(F.col("_h").isNotNull(), F.xxhash64("_h", "_o")).alias("d"))


def _cells(sent: DataFrame, keys: list[str], sides: int, width: int, salt: int) -> DataFrame:
    """keys, shard and cells, in order, of the elements (keys, shard, in, d), in being a bit for each side: one row for each shard."""
    parts = sent.select(*keys, "shard", "in", "d", F.expr(_check("d", salt)).alias("chk"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_part"))
    parts = parts.select(*keys, "shard", "in", "d", "chk", F.expr(_cell("d", "_part", width, salt)).alias("idx"))
    of = lambda i, c: F.when(F.col("in").bitwiseAND(1 << i) != 0, c).otherwise(0)
    sums = [x for i in range(sides) for x in (F.sum(of(i, 1)).cast("int").alias(f"c{i}"), F.bit_xor(of(i, F.col("d"))).alias(f"i{i}"), F.bit_xor(of(i, F.col("chk"))).alias(f"k{i}"))]
    summed = parts.groupBy(*keys, "shard", "idx").agg(*sums)
    return summed.groupBy(*keys, "shard").agg(F.sort_array(F.collect_list(F.struct("idx", *(f"{x}{i}" for i in range(sides) for x in "cik")))).alias("cells"))


def _compare(documents: DataFrame, unit_words: int, digests: bool = False) -> DataFrame:
    """doc_id, meta (next_id and sizes), print_0, print_1 and for both pairs the number of digests found, the shards that failed and, asked for, the digests."""
    ordered = with_next(documents).withColumn("n0", F.size(_units(F.col("text"), unit_words)))
    own = ordered.select("*", F.lead("doc_id").over(_in_order()).alias("next_id"), F.lead("n0").over(_in_order()).alias("n2"), _edit(F.col("text"), F.col("next_text")).alias("edited")).drop("next_text")
    own = own.withColumn("n1", F.size(_units(F.col("edited"), unit_words)))
    own = own.select("*", *(_shards(F.col(f"n{i}")).alias(f"s{i}") for i in range(3))).withColumn("mode", F.when(F.col("s1") == F.col("s0"), 1).otherwise(0) + F.when(F.col("s2") <= F.col("s0"), 2).otherwise(0))
    before = [F.lag(c).over(_in_order()).alias(f"before_{c}") for c in ("doc_id", "s0", "mode")]
    own = own.select("*", *before)
    meta = F.struct("next_id", F.length("text").cast("bigint").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), "n0", "n1", "n2")
    first = F.col("_copy") == 0
    kinds = F.array(
        F.struct(F.lit(0).alias("side"), _units(F.col("text"), unit_words).alias("u"), F.lit(None).alias("meta")),
        F.struct(F.lit(1).alias("side"), F.when(first, _units(F.col("edited"), unit_words)).alias("u"), F.lit(None).alias("meta")),
        F.struct(F.lit(2).alias("side"), F.when(first, F.array(F.lit(None).cast("string"))).alias("u"), meta.alias("meta")),
    )
    # The numbers of shards are powers of two of five bits each; with both modes they travel as one number.
    log = lambda c: F.round(F.log2(F.coalesce(c, F.lit(1)))).cast("bigint")
    sizes = F.coalesce("before_mode", F.lit(0)).cast("bigint") * 4 + F.col("mode")
    for c in ("s0", "s1", "s2", "before_s0"):
        sizes = sizes * 32 + log(F.col(c))
    place = ["bucket", "_copy", "doc_id", "before_doc_id", "sizes"]
    units = own.withColumn("sizes", sizes).select(*place, F.explode(kinds).alias("_k")).select(*place, "_k.side", "_k.meta", F.explode("_k.u").alias("_unit"))
    elements = _numbered(units, [*place, "meta"])
    s0, s1, s2, before_s0, mode, before_mode = (F.shiftright("sizes", by).bitwiseAND((1 << bits) - 1).cast("int") for by, bits in ((15, 5), (10, 5), (5, 5), (0, 5), (20, 2), (22, 2)))

    def send(when: Column, owner: str, mode: Column, t: int, held: Column, s: Column) -> Column:
        return F.when(when, F.struct(F.col(owner).alias("owner"), (mode + 4 * t + 16 * s).cast("int").alias("what"), held.cast("int").alias("in")))

    held, of_text, of_edited, meta_row = F.col("in"), F.col("in").bitwiseAND(1), F.col("in").bitwiseAND(2), F.col("d").isNull()
    following = (of_text != 0) & F.col("before_doc_id").isNotNull()
    targets = [
        send(first & ((s0 == s1) | (of_text != 0) | meta_row), "doc_id", mode, ALL, F.when(s0 == s1, held).otherwise(of_text), s0),
        send(first & (s2 > s0) & (of_text != 0), "doc_id", mode, WITH_NEXT, of_text, s2),
        send(first & (s0 != s1) & (of_edited != 0), "doc_id", mode, EDITED, of_edited, s1),
        send(first & (s0 != s1) & (held != 0), "doc_id", mode, WITH_EDITED, held, F.greatest(s0, s1)),
        send(following & (s0 <= before_s0), "before_doc_id", before_mode, ALL, F.lit(4), before_s0),
        send(following & (s0 > before_s0), "before_doc_id", before_mode, WITH_NEXT, F.lit(4), s0),
    ]
    sent = elements.select("bucket", "meta", "d", F.explode(F.array_compact(F.array(*targets))).alias("_t"))
    sent = sent.select("bucket", "meta", "d", "_t.*").withColumn("shard", F.col("d").bitwiseAND(F.expr("shiftleft(1L, shiftright(what, 4))") - 1).cast("int"))
    shards = _cells(sent, ["bucket", "owner", "what", "meta"], 3, PART, 0)
    shards = shards.select("*", F.shiftright("what", 2).bitwiseAND(3).alias("t"), F.col("what").bitwiseAND(3).alias("mode"), F.expr("shiftleft(1, shiftright(what, 4))").alias("s"))
    t, mode, real = F.col("t"), F.col("mode"), F.col("shard").isNotNull()
    with_edited = real & ((t == WITH_EDITED) | ((t == ALL) & (mode.bitwiseAND(1) != 0)))
    with_next_ = real & ((t == WITH_NEXT) | ((t == ALL) & (mode.bitwiseAND(2) != 0)))
    holds = lambda side: F.exists("cells", lambda c: (c[f"c{side}"] != 0) | (c[f"i{side}"] != 0))
    shards = shards.select(
        "bucket", "owner", "meta", "s", "shard",
        F.when(real & (t == ALL) & holds(0), F.struct("shard", _print(0).alias("x"))).alias("_p0"),
        F.when(real & t.isin(ALL, EDITED) & holds(1), F.struct("shard", _print(1).alias("x"))).alias("_p1"),
        F.when(with_edited, F.expr(_peeled(_difference(0, 1), PART, 0))).alias("_r1"),
        F.when(with_next_, F.expr(_peeled(_difference(0, 2), PART, 0))).alias("_r2"),
    )
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["x"]), "")
    out = [F.max("meta").alias("meta"), joined("_p0").alias("print_0"), joined("_p1").alias("print_1")]
    for r in ("_r1", "_r2"):
        ok = F.size(f"{r}.c") == 0
        out += [F.sum(F.when(ok, F.size(f"{r}.ids")).otherwise(0)).alias(f"d{r}"), F.collect_list(F.when(~ok, F.struct("s", "shard"))).alias(f"failed{r}")]
        if digests:
            out.append(F.collect_list(F.when(ok & (F.size(f"{r}.ids") > 0), F.col(f"{r}.ids"))).alias(f"ids{r}"))
    return shards.groupBy("bucket", "owner").agg(*out).withColumnRenamed("owner", "doc_id")


def _again(documents: DataFrame, todo: DataFrame, unit_words: int, width: int, salt: int) -> DataFrame:
    """doc_id, pair, shard, s and what peeling gave of the shards in todo (doc_id, next_id, pair, s, shards), from texts of their documents alone."""
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = todo.select("doc_id").unionByName(todo.select(F.col("next_id").alias("doc_id"))).distinct()
    texts = keep_ids(docs, stage(ids, "ids"), "doc_id").dropDuplicates(["doc_id"])
    rows = todo.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text")), "next_id")
    rows = rows.withColumn("other", F.when(F.col("pair") == 1, _edit(F.col("text"), F.col("next_text"))).otherwise(F.col("next_text")))
    keys = ["doc_id", "next_id", "pair", "s"]
    sides = F.array(*(F.struct(F.lit(i).alias("side"), _units(F.col(c), unit_words).alias("u")) for i, c in enumerate(("text", "other"))))
    units = rows.select(*keys, "shards", F.explode(sides).alias("_k")).select(*keys, "shards", "_k.side", F.explode("_k.u").alias("_unit"))
    elements = _numbered(units, [*keys, "shards"]).withColumn("shard", F.col("d").bitwiseAND(F.col("s") - 1).cast("int"))
    cells = _cells(elements.where(F.array_contains("shards", F.col("shard"))), keys, 2, width, salt)
    return cells.select(*keys, "shard", F.expr(_peeled(_difference(0, 1), width, salt)).alias("_r")).select(*keys, "shard", "_r.ids", (F.size("_r.c") > 0).alias("failed"))


def _settled(documents: DataFrame, unit_words: int, digests: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The comparison of all documents, and of what failed there the digests by shard from the retries (doc_id, pair, ids)."""
    first = stage(_compare(documents, unit_words, digests), "fingerprints")
    failed = [first.where(F.size(f"failed_r{i}") > 0).select("doc_id", "meta.next_id", F.lit(i).alias("pair"), F.explode(f"failed_r{i}").alias("_f")) for i in (1, 2)]
    gather = lambda df: df.groupBy("doc_id", "next_id", "pair", "s").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    todo = stage(gather(reduce(DataFrame.unionByName, failed).select("doc_id", "next_id", "pair", "_f.s", "_f.shard")), "todo")
    done, width = [], PART
    for salt in range(1, RETRIES + 1):
        if not todo.head(1):
            break
        width *= 4
        found = stage(_again(documents, todo, unit_words, width, salt), f"again{salt}")
        done.append(found.where("not failed").select("doc_id", "pair", "ids"))
        todo = stage(gather(found.where("failed")), f"todo{salt}")
    else:
        if todo.head(1):
            raise RuntimeError(f"{todo.count()} pairs did not peel in {RETRIES} retries")
    return first, reduce(DataFrame.unionByName, done) if done else None


def fingerprints(documents: DataFrame, unit_words: int = UNIT_WORDS) -> DataFrame:
    """The op7 contract: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    if not documents.where(F.col("doc_id").isNotNull()).head(1):
        return documents.sparkSession.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    first, again = _settled(documents, unit_words)
    near = first.select("doc_id", "meta", "print_0", "print_1", F.col("d_r1").alias("d1"), F.col("d_r2").alias("d2"))
    if again is not None:
        of = lambda k: F.sum(F.when(F.col("pair") == k, F.size("ids")).otherwise(0)).alias(f"more{k}")
        near = near.join(sized(stage(again.groupBy("doc_id").agg(of(1), of(2)), "more")), "doc_id", "left")
        near = near.select("doc_id", "meta", "print_0", "print_1", *((F.col(f"d{k}") + F.coalesce(f"more{k}", F.lit(0))).alias(f"d{k}") for k in (1, 2)))
    n = [F.col("meta.n0") + F.col(f"meta.n{i}") for i in (1, 2)]
    likeness = [F.when(n[i] == 0, 1.0).otherwise((n[i] - F.col(f"d{i + 1}")) / (n[i] + F.col(f"d{i + 1}"))) for i in (0, 1)]
    return near.select("doc_id", "meta.n_chars", F.lower(F.hex("meta.edited_sha256")).alias("edited_sha256"), F.col("print_0").alias("fingerprint"), F.col("print_1").alias("edited_fingerprint"), likeness[0].alias("near_edited"), likeness[1].alias("near_next"))


def differences(documents: DataFrame, unit_words: int = UNIT_WORDS) -> DataFrame:
    """doc_id, pair (edited or next), digest and side (1: in the text alone, -1: in the other alone) of every digest that peeling recovered."""
    first, again = _settled(documents, unit_words, True)
    rows = [first.select("doc_id", F.lit(i).alias("pair"), F.explode(F.flatten(f"ids_r{i}")).alias("_x")) for i in (1, 2)]
    if again is not None:
        rows.append(again.select("doc_id", "pair", F.explode("ids").alias("_x")))
    return reduce(DataFrame.unionByName, rows).select("doc_id", F.when(F.col("pair") == 1, "edited").otherwise("next").alias("pair"), F.col("_x.id").alias("digest"), F.col("_x.cnt").alias("side"))
