"""Fuzzy line deduplication with DataFrame functions alone.

Lines become distinct forms. A form's character shingles are hashed; its smallest
hashes, in order, are its signature (bottom-k MinHash), and runs of three of them
are its bands: forms of similarity 0.8 share a run of three among a union's 18
smallest hashes with probability 0.998. Every form of a bucket is verified against
the bucket's hub by exact Jaccard; then all bucket mates that are still in
different components are held against an exact bound on their similarity, and
all that pass it are verified. Connected components of the verified pairs are the
classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named_as, numbered, small, table
from .components import connected_components

SHINGLE, SIMILARITY = 8, 0.8
#: Smallest hashes of a signature, and how many in a row make a band. Without a run of 3 in 18 at 0.8: probability 0.0023.
LEAST, RUN = 18, 3
#: Hashes of a form that are gathered, about; where fewer than LEAST distinct ones come, the form is signed anew by all its hashes.
GATHERED = 32
#: Longs of a form's bitmap of shingles, each a column of its own, and how many of them are filled together.
LONGS, TOGETHER = 32, 4
#: Forms of a bucket that meet in one join key.
BLOCK = 1_000


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, line_no, line) of all lines; null ids and null texts have none. mark: hash of the text, to tell repeated ids apart."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return d.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _hashed(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their normal form (trimmed, lower case) and its 128-bit hash (h1, h2)."""
    normal = lines.where(F.trim("line") != "").select("doc_id", "mark", "line_no", F.lower(F.trim("line")).alias("norm"))
    return normal.select("*", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))


def _hashes(forms: DataFrame, keys: list[str], k: int, first: tuple = (), gathered: int | None = None) -> DataFrame:
    """(keys, h): a row for the hash of each shingle of norm (runs of k characters, or a whole shorter string).

    gathered: only the hashes below a bound that about that many fall under.
    first: columns that one more row for each form, with a null h, carries as
    one struct with w, the number of its shingles. Shingles are cut from a
    fixed-width encoding, inside generated code.
    """
    g = forms.withColumn("b", F.encode("norm", "UTF-32")).withColumn("w", F.expr(f"greatest(cast(length(b) / 4 as int) - {k - 1}, 1)"))
    bound = "9223372036854775807L" if gathered is None else f"if(w <= {gathered}, 9223372036854775807L, cast(1.8446744073709552E19D * {gathered} / w - 9.223372036854775808E18D as bigint))"
    g = g.withColumn("bound", F.expr(bound)).select(*keys, *first, "w", "b", "bound", F.explode(F.expr(f"sequence({0 if first else 1}, w)")).alias("i"))
    h = F.expr(f"xxhash64(substring(b, 4 * i - 3, {4 * k}))")
    if not first:
        return g.select(*keys, "bound", h.alias("h")).where("h <= bound").select(*keys, "h")
    once = F.when(F.col("i") == 0, F.struct(*first, "w")).alias("first")
    return g.select(*keys, once, "bound", F.when(F.col("i") > 0, h).alias("h")).where("h is null or h <= bound").select(*keys, "first", "h")


def _shingles(text: str, k: int) -> str:
    """SQL for the distinct hashes of _hashes as an array; the encoded text is a lambda's argument, so that it is made once."""
    return f"array_distinct(transform(array(encode({text}, 'UTF-32')), b -> transform(sequence(1, greatest(length(b) - {4 * k - 1}, 1), 4), i -> xxhash64(substring(b, i, {4 * k}))))[0])"


def _band_keys(s: str) -> Column:
    """Keys of the runs of a signature; those of four or five hashes have their pairs, those of one or two themselves as well.

    Sets of six or more hashes with similarity 0.8 always have a run in common
    if all their hashes are in their signatures.
    """
    runs = f"transform(slice({s}, 1, greatest(size({s}) - {RUN - 1}, 0)), (x, i) -> xxhash64(0, x, {s}[i + 1], {s}[i + 2]))"
    pairs = f"if(size({s}) in (4, 5), transform(slice({s}, 1, size({s}) - 1), (x, i) -> xxhash64(1, x, {s}[i + 1])), array())"
    return F.expr(f"concat({runs}, {pairs}, if(size({s}) in (1, 2), array(xxhash64(2, {s})), array()))")


def _least(column: str = "h") -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.collect_list(column))), 1, LEAST)


def signed_forms(lines: DataFrame, scratch: Scratch, k: int = SHINGLE) -> DataFrame:
    """(id, h1, h2, pos, n, keys) of the distinct forms of _hashed lines, as a written table.

    pos is the smallest (doc_id, line_no, mark) and n the number of a form's
    lines. One shuffle carries each distinct text once a task; the form is
    signed where it arrives. Forms that gather too few hashes, because they
    repeat the same shingles, are signed by all of their hashes.
    """
    forms = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "mark")).alias("pos"), F.count(F.lit(1)).alias("n"), F.first("norm").alias("norm"))
    rows = _hashes(forms, ["h1", "h2"], k, ("pos", "n", "norm"), GATHERED).groupBy("h1", "h2").agg(F.first("first", ignorenulls=True).alias("f"), _least().alias("s"))
    few = (F.size("s") < LEAST) & (F.col("f.w") > GATHERED)
    anew = F.expr(f"slice(sort_array({_shingles('f.norm', k)}), 1, {LEAST})")
    rows = rows.select("h1", "h2", "f.pos", "f.n", F.when(few, anew).otherwise(F.col("s")).alias("s"))
    return scratch.keep(rows.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "pos", "n", _band_keys("s").alias("keys")), "some")


def _bitmaps(texts: DataFrame, k: int) -> DataFrame:
    """(id, w, x0, x1, …): each form's number of shingles, repeats included, and the bitmap of their hashes.

    Filled by parts of TOGETHER longs, where each shingle is held against these alone; parts of a form stay in one partition.
    """
    h = _hashes(texts.repartition("id"), ["id"], k).select("id", F.expr(f"cast(shiftright(h, 6) & {LONGS - 1} as int)").alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    h = h.select("id", F.expr(f"at div {TOGETHER}").alias("part"), F.expr(f"at % {TOGETHER}").alias("at"), "bit")
    parts = h.groupBy("id", "part").agg(F.count(F.lit(1)).alias("w"), *(F.bit_or(F.expr(f"if(at = {j}, bit, 0L)")).alias(f"y{j}") for j in range(TOGETHER)))
    return parts.groupBy("id").agg(F.sum("w").alias("w"), *(F.bit_or(F.expr(f"if(part = {j // TOGETHER}, y{j % TOGETHER}, 0L)")).alias(f"x{j}") for j in range(LONGS)))


def _filled(marks: DataFrame) -> DataFrame:
    """marks with numbers that cannot be null. With checks for nulls the code of a join by _may_link is over 8,000 bytes long, which the JVM never compiles."""
    numbers = ["w", *(f"x{j}" for j in range(LONGS))]
    return marks.select(*(c for c in marks.columns if c not in numbers), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers))


def _may_link(a: str, b: str, similarity: float) -> Column:
    """Whether two forms' bitmaps allow that similarity: no pair that has it is ruled out.

    Each bit that differs comes from a shingle that only one of both has. With a
    similarity s, (1 - s) / (1 + s) of both sets' sizes is the most that can differ;
    w is a set's size or more.
    """
    differ = " + ".join(f"bit_count({a}.x{j} ^ {b}.x{j})" for j in range(LONGS))
    return F.expr(f"{differ} <= ({a}.w + {b}.w) * {(1 - similarity) / (1 + similarity) + 1e-9}D")


def _verified(near: DataFrame, texts: DataFrame, scratch: Scratch, name: str, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    both = near.join(texts.select(F.col("id").alias("a"), F.col("norm").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("norm").alias("y")), "b")
    sets = both.select("a", "b", F.expr(_shingles("x", k)).alias("x"), F.expr(_shingles("y", k)).alias("y"))
    shared = sets.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))
    # written before the filter, which Spark would otherwise push below the sets and so build them several times
    return scratch.keep(shared, name).where(F.col("n") >= F.lit(similarity) * (F.col("m") - F.col("n")) - 1e-9).select("a", "b")


def _apart(members: DataFrame, linked: DataFrame, marks: DataFrame, texts: DataFrame, scratch: Scratch, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of bucket mates in different components that may be similar, each once.

    The hub of a bucket has met all its mates already. Of the others, those of the
    largest component meet only the rest, and the rest meet each other, so a bucket of one
    class and a few outliers costs as many comparisons as it has forms for each outlier. Both groups are cut into
    blocks of about BLOCK forms and every two blocks that must meet do so in a join key of their
    own, so no key makes more than some BLOCK squared comparisons. Pairs that
    cannot be similar, and those that share a smaller key, end inside the join.
    """
    now = members.where("id <> hub").join(small(linked), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    now = scratch.keep(now, "now")
    parts = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top")).where("roots > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    mixed = scratch.keep(mixed.select("key", F.col("top.root").alias("lead"), blocks(F.col("top.c")).alias("of_lead"), blocks(F.col("m") - F.col("top.c")).alias("of")), "mixed")
    rows = scratch.keep(now.join(small(mixed), "key"), "rows")
    held = rows.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # LEAST keys at most
    held = scratch.keep(marks.join(held, "id"), "with")
    # where a bitmap has far fewer bits than so many different shingles would set, the repeats are left out of w
    set_bits = " + ".join(f"bit_count(x{j})" for j in range(LONGS))
    repeats = held.where(f"{set_bits} < 0.9 * {64 * LONGS} * (1 - exp(-w / {64 * LONGS}D))").select("id")
    sizes = texts.join(small(scratch.keep(repeats, "repeats")), "id", "left_semi").select("id", F.size(F.expr(_shingles("norm", k))).alias("size"))
    sizes = scratch.keep(sizes, "sizes")
    held = _filled(scratch.keep(held.join(small(sizes), "id", "left").withColumn("w", F.coalesce("size", "w")).drop("size"), "held"))
    rows = rows.join(held, "id").withColumn("leads", F.col("root") == F.col("lead")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.when(F.col("leads"), F.col("of_lead")).otherwise(F.col("of"))).cast("int"))
    form = ["id", "root", "keys", "w", *(f"x{j}" for j in range(LONGS))]
    meet = lambda kind, i, j: f"struct({kind} as kind, {i} as i, {j} as j)"
    ahead = F.expr(f"if(leads, transform(sequence(0, of - 1), b -> {meet(1, 'own', 'b')}), transform(sequence(own, of - 1), b -> {meet(0, 'own', 'b')}))")
    back = F.expr(f"concat(transform(sequence(0, own), b -> {meet(0, 'b', 'own')}), transform(sequence(0, of_lead - 1), b -> {meet(1, 'b', 'own')}))")
    at = [F.col("t.kind").alias("kind"), F.col("t.i").alias("i"), F.col("t.j").alias("j")]
    x = rows.withColumn("t", F.explode(ahead)).select("key", *at, *form).alias("p")
    y = rows.where("not leads").withColumn("t", F.explode(back)).select("key", *at, *form).alias("q")
    once = F.expr("p.root <> q.root and (p.kind = 1 or p.i < p.j or p.id < q.id)")
    least = F.expr("p.key = array_min(array_intersect(p.keys, q.keys))")
    same = F.expr("p.key = q.key and p.kind = q.kind and p.i = q.i and p.j = q.j")
    both = x.join(y, same & once & _may_link("p", "q", similarity) & least)
    out = both.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"))
    out = scratch.keep(out, "apart")
    scratch.drop("now", "mixed", "rows", "with", "repeats", "sizes", "held")
    return out


def line_classes(forms: DataFrame, lines: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """(id, root) for the forms that have a fuzzy duplicate.

    forms: id and keys; lines: norm; both have either id or (h1, h2) to meet by.

    First each bucket's forms are verified against its hub, the one that shares
    most with others, as many pairs as the buckets have members; this joins the
    large classes. Then all bucket mates that are still in different components are
    compared, so no link between bucket mates depends on the order of forms,
    on the size of a bucket or on the rest of the corpus.
    """
    scratch = scratch or Scratch(forms.sparkSession, "lines")
    by = ["id"] if "id" in lines.columns else ["h1", "h2"]
    bands = forms.select("id", F.explode("keys").alias("key"))
    full = scratch.keep(bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "full")
    members = scratch.keep(bands.join(small(full), "key").select("key", "id", "m"), "shared")
    shares = scratch.keep(members.groupBy("id").agg(F.sum(F.log2("m")).alias("shares")), "shares")
    wanted = scratch.keep(forms.join(small(shares.select("id")), "id", "left_semi").select(*{"id", *by}), "wanted")
    scratch.drop("full", "some")
    texts = lines.select(*by, "norm").join(small(wanted), by).groupBy("id").agg(F.first("norm").alias("norm"))
    texts = scratch.keep(texts, "texts")
    marks = _filled(scratch.keep(_bitmaps(texts, k), "marks"))
    hubs = members.join(small(shares), "id").groupBy("key").agg(F.max(F.struct("shares", "id"))["id"].alias("hub"))
    members = scratch.keep(members.join(small(scratch.keep(hubs, "hubs")), "key").select("key", "id", "hub"), "members")
    stars = members.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    near = stars.join(marks.alias("p"), F.col("a") == F.col("p.id")).join(marks.alias("q"), (F.col("b") == F.col("q.id")) & _may_link("p", "q", similarity))
    scratch.drop("shared", "shares", "wanted", "hubs")
    found = _verified(near.select("a", "b"), texts, scratch, "found", k, similarity)
    linked = scratch.keep(_linked(found), "linked")
    rest = _apart(members, linked, marks, texts, scratch, k, similarity)
    more = _verified(rest, texts, scratch, "more", k, similarity)
    out = scratch.keep(_linked(found.unionByName(more)), "classes")
    scratch.drop("texts", "marks", "members", "found", "linked", "apart", "more")
    return out


def _linked(found: DataFrame) -> DataFrame:
    return connected_components(found, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("root"))


def _kept_lines(docs: DataFrame, id_col: str, text_col: str, k: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(lines, keeps): _hashed lines, and (h1, h2, keep) of the forms that stand in several lines or are in a class of several forms."""
    lines = _hashed(lines_of(docs, id_col, text_col))
    scratch = Scratch(docs.sparkSession, "lines")
    signed = signed_forms(lines, scratch, k)
    forms = scratch.keep(signed.drop("keys"), "forms")
    classes = line_classes(signed, lines, k, similarity, scratch)
    roots = forms.join(small(classes), "id", "left").where("root is not null or n > 1").select("h1", "h2", "pos", F.coalesce("root", "id").alias("root"))
    roots = scratch.keep(roots, "roots")
    heads = roots.groupBy("root").agg(F.min("pos").alias("keep"))
    keeps = scratch.keep(roots.join(heads, "root").select("h1", "h2", "keep"), "keeps")
    scratch.drop("forms", "classes", "roots")
    return lines.select("doc_id", "mark", "line_no", "h1", "h2"), keeps


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, kept: one row per non-blank line.

    Lines are compared trimmed and in lower case. Of each class the line
    with the smallest (doc_id, line_no) is kept. Blank lines are no duplicates
    and have no row; documents with a null id or a null text have none either.
    Rows with one doc_id and different texts are different documents, rows with
    one doc_id and one text are the same document. A line shorter than a shingle
    is its own shingle. An empty table gives no rows; other columns are
    ignored.
    """
    lines, keeps = _kept_lines(docs, id_col, text_col, k, similarity)
    out = lines.join(small(keeps), ["h1", "h2"], "left")
    own = F.struct("doc_id", "line_no", "mark")
    keep = F.coalesce("keep", own)
    return out.select("doc_id", "line_no", keep["doc_id"].alias("keep_doc_id"), keep["line_no"].alias("keep_line_no"), (keep == own).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with their texts less the lines that are not kept; all rows and columns stay.

    A document that loses all its lines has an empty text. Null texts and
    documents with null ids are as they were. Of rows that repeat an id, each
    loses the lines of its own text only.
    """
    lines, keeps = _kept_lines(docs, id_col, text_col, k, similarity)
    gone = lines.join(small(keeps), ["h1", "h2"]).where(F.col("keep") != F.struct("doc_id", "line_no", "mark"))
    gone = Scratch(docs.sparkSession, "gone").keep(gone.groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("gone")), "gone")
    n = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    at, text = f"_{docs.columns.index(id_col)}", f"_{docs.columns.index(text_col)}"
    same = (F.col(at) == F.col("doc_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("mark"))
    out = numbered(docs).withColumn("lines", F.split(F.col(text), "\n", -1)).join(small(gone, n or 1), same, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    joined = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    return named_as(out.withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(joined)), docs)


def op3(spark, sf_dir: str) -> DataFrame:
    return line_decisions(table(spark, sf_dir, "documents"))
