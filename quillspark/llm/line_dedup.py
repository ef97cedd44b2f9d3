"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, cut, drop_scratch, materialize, stored

#: Codes of linked lines differ in at most so many of 63 bits.
RADIUS = 14
#: Votes for a bit are counted in lanes of nine bits; lines of more voting words have no code either.
CODED_WORDS = 511
_LANES = sum(1 << (9 * i) for i in range(7))
#: Sixteen longs of two blocks each: a word's hash falls in one of 32 blocks.
LONGS = 16
#: Blocks joined two by two are drawn from these sets, so any four of eight blocks hold a pair, and any three of four.
PAIRS_OF_8 = [(i, j) for group in ((0, 1, 2), (3, 4, 5), (6, 7)) for i in group for j in group if i < j]
PAIRS_OF_4 = [(i, j) for i in range(4) for j in range(i)]
#: Keys by the words of a line: (fewest words, most words, blocks of a line, blocks a key has). A range goes on past
#: the start of the next, as a line may have fewer words than one it is linked with.
FAMILIES = ((0, 22, 4, PAIRS_OF_4), (13, 66, 8, PAIRS_OF_8), (58, 132, 8, None), (116, 264, 16, None), (232, None, 32, None))
#: Only words of so many characters vote, as the commonest words are short and would make all long lines alike. Lines
#: with fewer such words than VOTERS have no code and are held to the edit similarity alone.
LEAST_CHARS, VOTERS = 5, 4
#: Words of 64 bits of a bitmap of ids; a broadcast bitmap has at most so many rows, whatever the input.
BITMAP_WORDS = 1 << 18

#: Before all others, so many pairs of a line with lines of other components are measured, those of nearest codes.
FIRST_PAIRS = 4

#: ASCII characters that are no letters or digits. Every run of them separates words.
SEPARATORS = "[\\x00-/:-@\\[-`{-\\x7f]+"


def words_of(line: Column) -> Column:
    """Lower-cased words of a line, which make it up to the normalised line."""
    return F.array_remove(F.split(F.lower(line), SEPARATORS), "")


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: equal only for rows of the same doc_id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def _named(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), "text")


def _union(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def block_keys() -> Column:
    """The keys of a line, from its blocks x0 to x15 and its number of words n; null in place of keys of empty blocks."""
    blocks = {
        32: [b for i in range(LONGS) for b in (F.col(f"x{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"x{i}", 32))],
        16: [F.col(f"x{i}") for i in range(LONGS)],
        8: [F.xxhash64(f"x{2 * i}", f"x{2 * i + 1}") for i in range(8)],
        4: [F.xxhash64(*[f"x{4 * i + j}" for j in range(4)]) for i in range(4)],
    }
    empty = F.xxhash64(*[F.lit(0).cast("long")] * 4)  # of four longs, as the blocks are hashed
    empty = {8: F.xxhash64(*[F.lit(0).cast("long")] * 2), 4: empty}

    def filled(a: Column, b: Column, parts: int) -> Column:
        """Whether a pair of blocks says enough: of eight both must hold words, of four one."""
        return (a != empty[parts]) & (b != empty[parts]) if parts == 8 else (a != empty[parts]) | (b != empty[parts])

    keys = []
    for no, (least, most, parts, pairs) in enumerate(FAMILIES):
        x = blocks[parts]
        own = [F.when(x[i] != empty.get(parts, 0), F.xxhash64(x[i], F.lit(64 * no + i))) for i in range(parts)] if pairs is None else [F.when(filled(x[i], x[j], parts), F.xxhash64(x[i], x[j], F.lit(64 * no + k))) for k, (i, j) in enumerate(pairs)]
        keys.append(F.when((F.col("n") >= least) & (F.col("n") <= (1 << 30 if most is None else most)), F.array(*own)).otherwise(F.array().cast("array<long>")))
    return F.concat(*keys)


def sketches(docs: DataFrame, least_words: int) -> DataFrame:
    """Every line of least_words words: doc_id, row, line_no (from 0), line (hash of its words in order), chars (length of its words joined), code, keys.

    Each occurrence of a word of LEAST_CHARS votes with 63 bits of its hash for the SimHash code. Every word falls into one of 32
    blocks; a block is the exclusive or of the hashes of its words, so a changed word changes the blocks of the old
    and of the new word and no other. Larger blocks are unions of those. All is summed in one pass of generated code.
    """
    uid = F.monotonically_increasing_id()  # keeps repeated rows apart within the pass
    lines = _named(docs).select("doc_id", "row", uid.alias("uid"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    words = lines.select("doc_id", "row", "uid", "line_no", F.posexplode(words_of(F.col("raw"))).alias("at", "word"))
    h = words.select("doc_id", "row", "uid", "line_no", "at", F.xxhash64("word").alias("h"), F.length("word").alias("len"))
    half = F.when(F.col("h").bitwiseAND(F.lit(1)) == 0, F.shiftrightunsigned("h", 32)).otherwise(F.shiftleft(F.shiftrightunsigned("h", 32), 32))
    h = h.withColumns({"half": half, "long": F.shiftright("h", 1).bitwiseAND(F.lit(LONGS - 1))})
    none = F.lit(0).cast("long")
    h = h.withColumn("vote", F.when(F.col("len") >= LEAST_CHARS, F.col("h")).otherwise(none))
    lane = lambda i: F.shiftrightunsigned("vote", i).bitwiseAND(F.lit(_LANES))
    sums = h.groupBy("doc_id", "row", "uid", "line_no").agg(
        *[F.bit_xor(F.when(F.col("long") == i, F.col("half")).otherwise(none)).alias(f"x{i}") for i in range(LONGS)],
        *[F.try_sum(lane(i)).alias(f"c{i}") for i in range(9)],
        F.count("*").alias("n"), F.count_if(F.col("len") >= LEAST_CHARS).alias("voters"), F.sum("len").alias("len"), F.bit_xor(F.xxhash64("h", "at")).alias("line"),
    )
    over = F.lit(255) - F.floor(F.col("voters") / 2)
    bits = lambda i: F.shiftleft(F.shiftrightunsigned((F.col(f"c{i}") + over * F.lit(_LANES)).bitwiseAND(F.lit(_LANES << 8)), 8), i)
    code = F.when(F.col("voters").between(VOTERS, CODED_WORDS), _union([bits(i) for i in range(9)]))
    return sums.where(F.col("n") >= least_words).select("doc_id", "row", "line_no", "line", (F.col("len") + F.col("n") - 1).cast("int").alias("chars"), code.alias("code"), block_keys().alias("keys"))


def most_edits(a: str, b: str, similarity: float) -> Column:
    """Edits that the similarity allows between lines of these lengths."""
    return F.floor((1 - F.lit(similarity)) * F.greatest(a, b) + 1e-9).cast("int")


def _close(x: str, y: str, similarity: float) -> Column:
    """Codes within RADIUS, and lengths that the similarity allows."""
    near = F.coalesce(F.bit_count(F.col(x + "_code").bitwiseXOR(F.col(y + "_code"))) <= RADIUS, F.lit(True))
    return near & (F.abs(F.col(x + "_chars") - F.col(y + "_chars")) <= most_edits(x + "_chars", y + "_chars", similarity))


def _between(words: str) -> Column:
    """The words of a line without the first `before` and the last `after`."""
    return F.slice(words, F.col("before") + 1, F.size(words) - F.col("before") - F.col("after"))


def edits(pairs: DataFrame, texts: DataFrame, similarity: float, reach: int = 1) -> DataFrame:
    """Pairs (a, b) with most, what the similarity allows, and edits, their edit distance as far as `reach` times that (null beyond).

    Words that both lines begin or end with add nothing to the distance and are left out. As the work grows with the
    bound, distances are first sought within the length of the words that one line has and the other has not, which
    is seldom too little, then within what the similarity allows.
    """
    joined = pairs.select("a", "b").join(texts.select(F.col("line").alias("b"), F.col("norm").alias("norm_b")), "b").join(texts.select(F.col("line").alias("a"), F.col("norm").alias("norm_a")), "a")
    joined = joined.withColumn("most", F.floor((1 - F.lit(similarity)) * F.greatest(F.length("norm_a"), F.length("norm_b")) + 1e-9).cast("int"))
    joined = joined.select("a", "b", "most", F.split("norm_a", " ").alias("wa"), F.split("norm_b", " ").alias("wb"))
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda v, w: F.coalesce(v == w, F.lit(False))), False).cast("int")
    size = F.least(F.size("wa"), F.size("wb"))
    first = F.when(same("wa", "wb") == 0, size).otherwise(same("wa", "wb") - 1)
    joined = joined.withColumn("before", first).withColumn("after", F.least(size - F.col("before"), F.when(same(F.reverse("wa"), F.reverse("wb")) == 0, size).otherwise(same(F.reverse("wa"), F.reverse("wb")) - 1)))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mid = joined.repartition(tasks, "a", "b").select("a", "b", "most", _between("wa").alias("wa"), _between("wb").alias("wb"))
    alone = lambda x, y: F.length(F.array_join(F.array_except(x, y), " "))
    flat = lambda w: F.concat(F.array_join(w, " "), F.when(F.size(w) > 0, " ").otherwise(""))
    mid = mid.select("a", "b", "most", F.least("most", F.greatest(alone("wa", "wb"), alone("wb", "wa")) + 4).alias("guess"), flat("wa").alias("x"), flat("wb").alias("y"))
    found = F.expr("coalesce(nullif(levenshtein(x, y, guess), -1), case when guess < most then nullif(levenshtein(x, y, most), -1) end" + (f", nullif(levenshtein(x, y, {reach} * most), -1))" if reach > 1 else ")"))
    return mid.select("a", "b", "most", found.cast("int").alias("edits"))


def _bitmap(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap of hashed ids: word, bits; BITMAP_WORDS rows at most."""
    h = F.pmod(F.xxhash64(column), F.lit(64 * BITMAP_WORDS))
    return ids.select(F.floor(h / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _perhaps_in(rows: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """rows without most of those whose id is not in the bitmap; all that are in it stay."""
    h = F.pmod(F.xxhash64(column), F.lit(64 * BITMAP_WORDS))
    keyed = rows.withColumns({"word": F.floor(h / 64), "_bit": (h % 64).cast("int")})
    # at most BITMAP_WORDS rows
    return keyed.join(F.broadcast(bitmap), "word").where(F.call_function("shiftrightunsigned", F.col("bits"), F.col("_bit")).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def _texts(docs: DataFrame, lines: DataFrame, nodes: DataFrame, pairs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """line, norm (its words joined) of the lines in pairs, each read from one row that has it; and the path they are in."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    wanted = nodes.select("line", "row").join(wanted, "line", "left_semi")
    places = lines.select("line", "row", "line_no").join(wanted, ["line", "row"]).groupBy("row", "line").agg(F.min("line_no").alias("line_no"))
    places, at = stored(places.groupBy("row").agg(F.collect_list(F.struct("line", "line_no")).alias("places")), f"{label}-places")
    some = _perhaps_in(_named(docs).select("row", "text"), "row", _bitmap(places, "row")).join(places, "row")
    texts = some.select(F.split("text", "\n").alias("raw"), F.explode("places").alias("p"))
    texts = texts.select("p.line", F.array_join(words_of(F.get("raw", F.col("p.line_no"))), " ").alias("norm"))
    out = stored(texts.groupBy("line").agg(F.min("norm").alias("norm")), f"{label}-texts")
    drop_scratch(docs.sparkSession, at)
    return out


def pairs_across(known: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines that share a bucket, are in different components and may be linked: a, b, x (the one outside the bucket's main component, or the smaller), apart (bits that their codes differ in). Each pair comes once.

    known: members y of buckets with several components, with part, main (the bucket's largest component), least and
    upmost (bounds of the distance from the head), y_code, y_chars and y_in (the buckets of y). A pair that shares several
    buckets meets in the least of them only: what proves it apart there does so for all, and what does not, need not be said again.
    """
    outside = known.where("part <> main").select(F.col("bucket").alias("x_bucket"), *[F.col(c).alias("x_" + c) for c in ("part", "least", "upmost")], F.col("y").alias("x"), F.col("y_code").alias("x_code"), F.col("y_chars").alias("x_chars"), F.col("y_in").alias("x_in"))
    allowed = most_edits("x_chars", "y_chars", similarity)
    metric = (F.col("x_least") - F.col("upmost") <= allowed) & (F.col("least") - F.col("x_upmost") <= allowed)
    once = (F.col("part") == F.col("main")) | (F.col("x") < F.col("y"))
    here = F.array_min(F.array_intersect("x_in", "y_in")) == F.col("bucket")
    crossing = outside.join(known, (F.col("x_bucket") == F.col("bucket")) & (F.col("part") != F.col("x_part")) & once & metric & _close("x", "y", similarity) & here)
    apart = F.coalesce(F.bit_count(F.col("x_code").bitwiseXOR(F.col("y_code"))), F.lit(RADIUS + 1))
    return crossing.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "x", apart.alias("apart"))


def line_groups(docs: DataFrame, lines: DataFrame, similarity: float = 0.9) -> DataFrame:
    """Distinct normalised lines that occur more than once or are linked to another line.

    lines: sketches(docs). Returns line (hash of the normalised line) and part (smallest line of its component).
    Lines that occur once without a link are left out.

    Lines that share a key are in a bucket. They are first compared with the head of the bucket, the line that
    shares the largest part of its keys, as an unedited line shares more than its edited copies. Where that leaves a bucket
    with several components, lines outside its largest one are compared with those of other components, but for
    pairs whose distances from the head differ by more than a link allows; a pair that shares several such buckets
    meets only in the least of them, as a bucket that proves it apart does so for all. Of these the FIRST_PAIRS of nearest codes
    of each line are measured first, then those that are still in two components. So a bucket of one group costs a
    pass, and no link within a bucket is missed. Scratch tables are deleted as soon as they are no longer read.
    """
    spark = docs.sparkSession
    nodes, nodes_at = stored(lines.groupBy("line").agg(F.min("row").alias("row"), F.count("*").alias("n"), F.min("code").alias("code"), F.min("chars").alias("chars"), F.min(F.size("keys")).alias("n_keys")), "line-nodes")
    keys = lines.select("line", F.explode("keys").alias("bucket")).where("bucket is not null")
    shared = keys.groupBy("bucket").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select("bucket")
    members, members_at = stored(keys.join(shared.hint("shuffle_hash"), "bucket", "left_semi").distinct(), "line-members")
    share = F.floor(F.least(F.col("shared") / F.col("n_keys"), F.lit(1.0)) * ((1 << 20) - 1)).cast("long")
    rank = F.shiftleft(share, 43).bitwiseOR(F.col("line").bitwiseAND(F.lit((1 << 43) - 1)))
    facts = members.groupBy("line").agg(F.count("*").alias("shared")).join(nodes, "line").select("line", "code", "chars", rank.alias("rank"))
    members, facts_at = stored(members.join(facts, "line").select("bucket", "rank", F.col("line").alias("b"), F.col("code").alias("b_code"), F.col("chars").alias("b_chars")), "line-facts")
    drop_scratch(spark, members_at)
    heads = members.groupBy("bucket").agg(*[F.max_by(f"b{c}", "rank").alias(f"a{c}") for c in ("", "_code", "_chars")])
    star = members.join(heads, "bucket").where((F.col("a") != F.col("b")) & _close("a", "b", similarity))

    def measured(pairs: DataFrame, label: str, reach: int) -> DataFrame:
        pairs, at = stored(pairs, f"{label}-pairs")
        texts, texts_at = _texts(docs, lines, nodes, pairs, label)
        out = cut(edits(pairs, texts, similarity, reach))
        drop_scratch(spark, at)
        drop_scratch(spark, texts_at)
        return out

    near = measured(star.select("a", "b").distinct(), "line-star", 2)
    link = lambda pairs: pairs.where("edits <= most").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = link(near)
    parts = cut(connected_components(edges))

    placed = members.join(parts.select(F.col("node").alias("b"), "component"), "b", "left").withColumn("part", F.coalesce("component", "b"))
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    divided = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("main")).where("parts > 1").select("bucket", "main")
    mixed = placed.join(divided, "bucket").join(heads.select("bucket", "a"), "bucket").join(near, ["a", "b"], "left")
    far = F.lit(1 << 30)
    known = mixed.withColumns({"least": F.when(F.col("a") == F.col("b"), 0).when(F.col("most").isNull(), 0).otherwise(F.coalesce("edits", 2 * F.col("most") + 1)), "upmost": F.when(F.col("a") == F.col("b"), 0).otherwise(F.coalesce("edits", far))})
    known, known_at = stored(known.select("bucket", "part", "main", "least", "upmost", F.col("b").alias("y"), F.col("b_code").alias("y_code"), F.col("b_chars").alias("y_chars"), F.collect_list("bucket").over(Window.partitionBy("b")).alias("y_in")), "line-divided")
    drop_scratch(spark, facts_at)
    crossing, crossing_at = stored(pairs_across(known, similarity), "line-crossing")
    drop_scratch(spark, known_at)
    rest, known_parts = crossing.select("a", "b"), parts.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    near_first = Window.partitionBy("x").orderBy("apart", "a", "b")
    first = crossing.withColumn("place", F.row_number().over(near_first)).where(F.col("place") <= FIRST_PAIRS).select("a", "b").distinct()
    links = cut(connected_components(link(measured(first, "line-first", 1)).unionByName(known_parts)))
    of = lambda c: links.select(F.col("node").alias(c), F.col("component").alias(c + "_part"))
    rest = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")
    more = link(measured(rest, "line-rest", 1))
    drop_scratch(spark, crossing_at)
    parts = cut(connected_components(more.unionByName(links.select(F.col("node").alias("src"), F.col("component").alias("dst")))))

    named = nodes.select("line", "n").join(parts.withColumnRenamed("node", "line"), "line", "left")
    out = materialize(named.where(F.col("component").isNotNull() | (F.col("n") > 1)).select("line", F.coalesce("component", "line").alias("part")), "line-groups")
    drop_scratch(spark, nodes_at)
    return out


def duplicate_lines(docs: DataFrame, least_words: int = 5, similarity: float = 0.9) -> DataFrame:
    """The lines to drop of each row: doc_id, row (see row_key), drop (sorted line numbers from 0), gone (whether no line of least_words words stays); only rows that drop any.

    Of each connected group of lines one occurrence stays: that of smallest doc_id, row and line number.
    """
    lines, lines_at = stored(sketches(docs, least_words), "line-sketches")
    groups = line_groups(docs, lines, similarity)
    found = lines.select("line", F.struct("doc_id", "row", "line_no").alias("at")).join(groups, "line").select("part", "at")
    keepers = found.groupBy("part").agg(F.min("at").alias("keeper"))
    drops = found.join(keepers, "part").where("at <> keeper").groupBy("at.doc_id", "at.row").agg(F.array_sort(F.collect_set("at.line_no")).alias("drop"))
    full = lines.groupBy("doc_id", "row").agg(F.count_distinct("line_no").alias("full"))
    out = materialize(drops.join(full, ["doc_id", "row"]).select("doc_id", "row", "drop", (F.size("drop") == F.col("full")).alias("gone")), "line-drops")
    drop_scratch(docs.sparkSession, lines_at)
    return out


def _with_drops(docs: DataFrame, keyed: DataFrame, least_words: int, similarity: float) -> DataFrame:
    """keyed (docs with _quill_id and _quill_row, and no need of its text) with _quill_drop, null if none, and _quill_gone.

    Of repeated rows, of one doc_id and text, all but one drop every line of least_words words.
    """
    drops = duplicate_lines(docs, least_words, similarity).select(F.col("doc_id").alias("_quill_id"), F.col("row").alias("_quill_row"), F.col("drop").alias("_quill_drop"), F.col("gone").alias("_quill_gone"))
    joined = keyed.join(drops, ["_quill_id", "_quill_row"], "left").withColumn("_quill_gone", F.coalesce("_quill_gone", F.lit(False)))
    rows = docs.select(*_keys(docs)).where("_quill_id is not null").groupBy("_quill_id", "_quill_row").agg(F.count("*").alias("rows"))
    repeated = materialize(rows.where("rows > 1").drop("rows"), "line-repeated")
    if repeated.isEmpty():
        return joined
    named = docs.select("doc_id", "text", *_keys(docs)).join(repeated, ["_quill_id", "_quill_row"], "left_semi").dropDuplicates(["_quill_id", "_quill_row"])
    raw = F.split("text", "\n")
    full = F.filter(F.sequence(F.lit(0), F.size(raw) - 1), lambda i: F.size(words_of(F.get(raw, i))) >= least_words)
    full = named.select("_quill_id", "_quill_row", full.alias("_quill_full"))
    copy_no = F.row_number().over(Window.partitionBy("_quill_id", "_quill_row").orderBy("_quill_row"))
    copies = joined.join(full, ["_quill_id", "_quill_row"]).withColumn("_quill_copy", copy_no)
    later = (F.col("_quill_copy") > 1) & (F.size("_quill_full") > 0)
    copies = copies.withColumns({"_quill_drop": F.when(later, F.col("_quill_full")).otherwise(F.col("_quill_drop")), "_quill_gone": later | F.col("_quill_gone")})
    return joined.join(repeated, ["_quill_id", "_quill_row"], "left_anti").unionByName(copies.drop("_quill_copy", "_quill_full"))


def _keys(docs: DataFrame) -> list[Column]:
    """What _with_drops joins by: _quill_id, null for rows that take no part, and _quill_row."""
    return [F.when(docs["text"].isNotNull(), docs["doc_id"].cast("long")).alias("_quill_id"), row_key(docs).alias("_quill_row")]


def dedup_lines(docs: DataFrame, least_words: int = 5, similarity: float = 0.9) -> DataFrame:
    """docs without repeated and fuzzily repeated lines; same columns, text changed, n_chars made to fit.

    Two lines of at least least_words words are linked if equal after normalising, or if they share a key, their
    SimHash codes differ in at most RADIUS of 63 bits and their edit distance is at most 1 - similarity of the
    longer one's length. Links make groups; of each group one occurrence stays. Lines that stay keep their exact
    text and order. Shorter and empty lines stay, as do lines of a document that loses nothing.

    A row all of whose lines of least_words words are dropped goes as a whole, as nothing but scraps would
    stay (report marks such rows); rows without such lines stay. Null or empty text and rows with null doc_id stay
    as they are. Rows that share a doc_id but not a text are documents of their own; of rows that share both, one
    stays. An empty table stays empty.
    """
    out = _with_drops(docs, docs.select("*", *_keys(docs)), least_words, similarity).where(~F.col("_quill_gone"))
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("no"))), lambda s: ~F.array_contains("_quill_drop", s["no"]))
    out = out.withColumn("_quill_text", F.when(F.col("_quill_drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["line"]), "\n")))
    columns = [F.col("_quill_text").alias(c) if c == "text" else F.when(F.col("_quill_drop").isNull(), F.col(c)).otherwise(F.length("_quill_text")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def report(docs: DataFrame, least_words: int = 5, similarity: float = 0.9) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_lines, n_dropped, dropped (line numbers from 0), gone (whether dedup_lines drops the row)."""
    n = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), n.alias("n_lines"), *_keys(docs))
    out = _with_drops(docs, keyed, least_words, similarity)
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("_quill_drop"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("_quill_drop", none).alias("dropped"), F.col("_quill_gone").alias("gone"))
