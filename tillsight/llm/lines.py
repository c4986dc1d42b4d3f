"""Removal of repeated and nearly repeated lines by an exact set-similarity join.

The tokens of a line are the hashes of its five-word shingles. Lines that are similar enough share some of their first tokens in
any order common to all. Lines that share too few are done: this first cut looks at the outer words of a shingle only and takes it
to be as rare as the word it starts with is long. The tokens of the lines that remain are counted and ordered by rarity;
the lines are joined on their first ones, the join is cut by length, position and a bitmap of the tokens, and what is left is
verified on whole token sets.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.common import sent_if_small, table, without
from tillsight.llm.graph import connected_components
from tillsight.plans.shared import stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits of a line's bitmap, 64 to a number, and rounds in which lines are paired one by one before all that remain.
BITMAP = 512
ROUNDS = 2
#: Bits of a token that come from its hash; its rank stands above them.
HASHED = 56

BITS = [f"bits{i}" for i in range(BITMAP // 64)]


def with_words(lines: DataFrame) -> DataFrame:
    """`key` and, in place of `line`, its `words`. Each step is a column of its own, so that no step is computed twice."""
    lowered = lines.select("key", F.lower("line").alias("line"))
    other = F.contains("line", F.lit("\t")) | F.contains("line", F.lit("\r"))
    # Most lines have neither other separators nor empty words: they are looked for before anything is copied.
    spaced = F.when(other, F.replace(F.replace("line", F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))).otherwise(F.col("line"))
    parts = lowered.select("key", spaced.alias("line")).select("key", F.split("line", " ").alias("words"))
    filled = F.when(F.array_contains("words", ""), F.array_remove("words", "")).otherwise(F.col("words"))
    return parts.select("key", filled.alias("words"))


def lines_of(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`doc_id`, `row` (hash of the text), `pos` (from 0), `key` (hash of the line) and `line` of every line with words."""
    value = F.col(f"`{text}`")
    # The hash is a column of its own, else it would be made again for every line of the text.
    texts = documents.where(value.isNotNull()).select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(value).alias("row"), F.split(value, "\n").alias("parts")
    )
    # outer: a plain explode is given a filter on its array, for which a text would be split again. No text is without lines,
    # so both give the same rows. Trimming one side is enough to find a line without words.
    return (
        texts.select("doc_id", "row", F.posexplode_outer("parts").alias("pos", "line"))
        .where(F.ltrim("line", F.lit(" \t\r")) != "")
        .select("doc_id", "row", "pos", F.xxhash64("line").alias("key"), "line")
    )


def sketched_lines(lines: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """`key`, `most`, `least` and `first` of every distinct line: what the first cut looks at.

    A sketched token is the hash of the first and the last word of a shingle below the length of the first one, long words
    first. Several shingles may have the same, so a line has at least `least` shingles (its distinct sketched tokens) and at
    most `most` (its places), and lacks no more sketched tokens of another line than shingles. `first` holds the first ones: as
    many as may be missing from a similar line, one more, and half as many again.
    """

    def sketched(first: Column, last: Column) -> Column:
        # The high bits hold the length inverted; from 128 bytes on it starts again, any order common to all lines will do. A
        # length that cannot be null leaves plain numbers to sort.
        rank = F.shiftleft(F.coalesce(F.octet_length(first), F.lit(0)).cast("bigint"), HASHED)
        return F.xxhash64(first, last).bitwiseOR(F.lit(-1 << HASHED)).bitwiseXOR(rank)

    # Each step is a column of its own, so that no step is computed twice.
    words = with_words(lines.select("key", "line"))
    # A line of fewer words than a shingle has no last word: null meets its first one.
    starts = F.slice("words", 1, F.greatest(F.size("words") - (size - 1), F.lit(1)))
    outer = words.select("key", starts.alias("firsts"), F.slice("words", size, F.size("words")).alias("lasts"))
    made = outer.select("key", F.size("firsts").alias("most"), F.zip_with("firsts", "lasts", sketched).alias("tokens"))
    made = made.select("key", "most", F.sort_array(F.array_distinct("tokens")).alias("tokens"))
    first = F.slice("tokens", 1, F.col("most") - least_shared(F.col("most"), similarity) + 1 + _spare(F.col("most"), similarity))
    # Copies of a line are folded before its tokens meet others.
    once = made.select("key", F.struct("most", F.size("tokens").alias("least"), first.alias("first")).alias("line"))
    return once.groupBy("key").agg(F.first("line").alias("line")).select("key", "line.*")


def _spare(n: Column, similarity: Fraction) -> Column:
    """Half of the tokens of n that may be missing from a similar line."""
    p, q = similarity.numerator, similarity.denominator
    return F.floor(n * (q - p) / (2 * q)).cast("int")


def _needed(most: Column, least: Column, similarity: Fraction) -> Column:
    """How many of its first sketched tokens a line has in common with those of any similar one."""
    # The other line has at least `least_shared` shingles, and so at least as many spare ones.
    spare = _spare(least_shared(least, similarity), similarity)
    return F.greatest(F.least(spare + 1, least - most + least_shared(most, similarity)), F.lit(1))


def met_keys(sketched: DataFrame, similarity: Fraction) -> DataFrame:
    """`key` of the lines of which enough first tokens meet another line, where lengths and places allow enough shared ones."""
    p, q = similarity.numerator, similarity.denominator
    # outer: a plain explode is given a filter on its array, for which all steps would be computed again. No line is without
    # tokens, so both give the same rows.
    placed = sketched.select("key", "most", "least", F.posexplode_outer("first").alias("pos", "token"))
    needed = _needed(F.col("x.most"), F.col("x.least"), similarity)

    def possible(one: str, other: str) -> Column:
        # Before a needed token are those the other line lacks, and less than `needed` shared ones.
        lacking, bound = F.col(f"{one}.pos") - needed + 1, F.col(f"{one}.most") * q - F.col(f"{other}.least") * p
        return (bound >= 0) & (lacking * (p + q) <= bound)

    # One exchange serves both sides; a row is done with its first partner.
    other = (F.col("x.token") == F.col("y.token")) & (F.col("x.key") != F.col("y.key")) & possible("x", "y") & possible("y", "x")
    met = placed.alias("x").join(placed.alias("y"), other, "left_semi")
    met = met.groupBy("key").agg(F.count("*").alias("met"), F.first("most").alias("most"), F.first("least").alias("least"))
    return met.where(F.col("met") >= _needed(F.col("most"), F.col("least"), similarity)).select("key")


def with_shingles(lines: DataFrame, size: int) -> DataFrame:
    """Replace `words` by `run0`, the hashes of the words, and `shingles`, the hashes of its runs of `size` words.

    A line of fewer words is one shingle. Runs of 2, 4, 8 ... words are made from their halves, and the size asked
    for from its binary digits. Each step is a column of its own, so that no step is computed twice.
    """
    others = [c for c in lines.columns if c != "words"]
    now = lines.select(*others, F.transform("words", lambda x: F.xxhash64(x)).alias("run0"))
    runs, made, covered = 1, None, 0
    while 1 << runs <= size:
        now = now.withColumn(f"run{runs}", _joined(f"run{runs - 1}", f"run{runs - 1}", 1 << (runs - 1)))
        runs += 1
    for k in range(runs - 1, -1, -1):
        if size & (1 << k):
            now = now.withColumn("made", _joined("made", f"run{k}", covered)) if made else now.withColumn("made", F.col(f"run{k}"))
            made, covered = True, covered + (1 << k)
    count = F.size("run0")
    shingles = F.slice("made", 1, F.greatest(count - (size - 1), F.lit(0)))
    return now.select(*others, "run0", F.when(count < size, F.array(F.xxhash64("run0"))).otherwise(shingles).alias("shingles"))


def _joined(left: str, right: str, shift: int) -> Column:
    return F.zip_with(left, F.slice(right, shift + 1, F.size("run0")), lambda a, b: F.xxhash64(a, b))


def least_shared(n: Column, similarity: Fraction) -> Column:
    """Tokens a set of n must share with any similar enough set: ceil(t n)."""
    p, q = similarity.numerator, similarity.denominator
    return F.floor((n * p + (q - 1)) / q).cast("int")


def _enough(shared: Column, n: Column, m: Column, similarity: Fraction) -> Column:
    p, q = similarity.numerator, similarity.denominator
    return shared * (p + q) >= (n + m) * p


def _fits(a: str, b: str, similarity: Fraction) -> Column:
    """Length and positional filter for two lines that meet in a token with so many tokens `left` from there on."""
    n, m, i, j = (F.col(f"{x}.{c}") for c in ("n", "left") for x in (a, b))
    p, q = similarity.numerator, similarity.denominator
    return (n * q >= m * p) & (m * q >= n * p) & _enough(F.least(i, j), n, m, similarity)


def first_tokens(ranked: DataFrame, similarity: Fraction) -> DataFrame:
    """`held` (tokens kept of n) and `first`, the tokens one of which any similar enough line shares, in place of `tokens`."""
    held, n = F.size("tokens"), F.col("n")
    first = F.slice("tokens", 1, held - least_shared(n, similarity) + 1)
    return ranked.select(*(c for c in ranked.columns if c != "tokens"), held.alias("held"), first.alias("first"))


def placed_tokens(first: DataFrame) -> DataFrame:
    """A row for each of the first tokens: `lost` of the line's tokens are not kept, `left` are from this one on."""
    # outer, as above.
    rows = first.select("key", "n", "held", F.posexplode_outer("first").alias("pos", "token"))
    return rows.select("key", "n", (F.col("n") - F.col("held")).alias("lost"), (F.col("held") - F.col("pos")).alias("left"), "token")


def _verified(pairs: DataFrame, ranked: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs `a`, `b` of lines whose token sets are similar enough."""
    x, y = ranked.alias("x"), ranked.alias("y")
    beside = pairs.join(x, F.col("a") == F.col("x.key")).join(y, F.col("b") == F.col("y.key"))
    shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
    return beside.where(_enough(shared, F.col("x.n"), F.col("y.n"), similarity)).select("a", "b")


def contested_lines(lines: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """`key`, `n` and `tokens` of the distinct lines that can have a similar enough partner.

    First the lines that meet others in enough of their first sketched tokens. Of these all tokens are counted: `tokens` holds
    those that another of them has, rarest first (`n` counts all), and only lines of which enough are left go on.
    """
    keys = sent_if_small(stored(met_keys(sketched_lines(lines, size, similarity), similarity), "contested-keys"))
    again = lines.select("key", "line").join(keys, "key", "left_semi").groupBy("key").agg(F.first("line").alias("line"))
    made = with_shingles(with_words(again), size)
    made = made.select("key", F.array_distinct("shingles").alias("shingles"))
    made = stored(made.select("key", F.size("shingles").alias("n"), "shingles"), "contested-tokens")
    hashed = F.col("shingle").bitwiseAND(F.lit((1 << HASHED) - 1)).alias("token")
    tokens = made.select("key", "n", F.explode_outer("shingles").alias("shingle")).select("key", "n", hashed)
    counts = tokens.groupBy("token").agg(F.count("*").alias("lines")).where("lines > 1")
    # Up to 63 lines are told apart, more by their digits.
    rank = F.when(F.col("lines") < 64, F.col("lines")).otherwise(F.floor(F.log2("lines")) + 64).cast("bigint")
    counts = counts.select("token", F.shiftleft(rank, HASHED).bitwiseOR(F.col("token")).alias("ranked"))
    common = tokens.join(counts, "token").select("key", "n", "ranked").repartition("key").groupBy("key", "n").agg(F.sort_array(F.collect_list("ranked")).alias("tokens"))
    return stored(common.where(F.size("tokens") >= least_shared(F.col("n"), similarity)), "contested-lines")


def with_bits(lines: DataFrame) -> DataFrame:
    """Add bits that tell which tokens a line can have."""
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    number = F.expr(f"cast(shiftright(token, 6) & {BITMAP // 64 - 1} as int)")
    rows = lines.select("key", F.explode_outer("tokens").alias("token"))
    bits = rows.groupBy("key").agg(*(F.coalesce(F.bit_or(F.when(number == i, bit)), F.lit(0)).alias(name) for i, name in enumerate(BITS)))
    return lines.join(bits, "key")


def _can_share(similarity: Fraction) -> Column:
    """Enough shared tokens as far as the lines' bits tell: a bit that only one line has stands for a token the other lacks."""

    def most(one: str, other: str) -> Column:
        lacking = (F.bit_count(F.col(f"{one}.{b}").bitwiseAND(F.bitwise_not(f"{other}.{b}"))) for b in BITS)
        return F.col(f"{one}.n") - F.col(f"{one}.lost") - sum(lacking)

    return _enough(F.least(most("x", "y"), most("y", "x")), F.col("x.n"), F.col("y.n"), similarity)


def led_pairs(lines: DataFrame, possible: Column, order: Column, count: int) -> DataFrame:
    """A pair for each line at most: with the first, by `order`, of the lines of another component that lead one of its tokens.

    A token is led by one line of each of `count` components, the first by `order`.
    """
    kept = [c for c in lines.columns if c not in ("token", "component")]
    leads = lines.groupBy("token", "component").agg(F.min(F.struct(order.alias("order"), *kept)).alias("lead"))
    leads = leads.select("token", "lead.*", "component")
    if count == 1:
        leads = leads.groupBy("token").agg(F.min(F.struct("order", *kept, "component")).alias("lead")).select("token", "lead.*")
    else:
        place = F.row_number().over(Window.partitionBy("token").orderBy("order", "key"))
        leads = leads.withColumn("place", place).where(F.col("place") <= count).drop("place")
    met = lines.alias("x").join(leads.alias("y"), "token").where((F.col("x.component") != F.col("y.component")) & possible)
    one = met.groupBy(F.col("x.key").alias("key")).agg(F.min(F.struct("y.order", "y.key")).alias("lead"))
    return one.select(F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b")).distinct()


def open_lines(lines: DataFrame, components: DataFrame) -> DataFrame:
    """Lines by token, with their component so far, where lines of several components meet."""
    known = components.select(F.col("node").alias("key"), F.col("component").alias("joined"))
    labelled = lines.drop("component").join(known, "key", "left").withColumn("component", F.coalesce("joined", "key")).drop("joined")
    several = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return labelled.join(several.select("token"), "token", "left_semi")


def line_classes(documents: DataFrame, doc_id: str, text: str, size: int, similarity: Fraction) -> DataFrame:
    """`key`, `component` of the lines that are similar to another line, over any number of links."""
    ranked = contested_lines(lines_of(documents, doc_id, text), size, similarity)
    placed = placed_tokens(first_tokens(ranked, similarity)).withColumn("component", F.col("key"))
    fits = _fits("x", "y", similarity)
    # Groups of near copies grow together with one pair for each line and round instead of all pairs: first with the line
    # that shares most of itself, then with any other that leads a token.
    order = F.struct("lost", "n")
    links = stored(_verified(led_pairs(placed, fits, order, 1), ranked, similarity), "line-links")
    components = stored(connected_components(links, "a", "b"), "line-components")
    rest = stored(open_lines(placed, components), "open-lines")
    for number in range(ROUNDS):
        found = stored(_verified(led_pairs(rest, fits, F.xxhash64("key", F.lit(number)), 2), ranked, similarity), "line-links")
        if found.isEmpty():
            break
        links = links.union(found)
        components = stored(connected_components(links, "a", "b"), "line-components")
        rest = stored(open_lines(rest, components), "open-lines")
    # Then the lines that still meet in a token without being linked: compared where they meet, so that only links come out.
    open_keys = rest.select("key").distinct()
    rest = rest.join(with_bits(ranked.select("key", "tokens").join(open_keys, "key", "left_semi")), "key")
    possible = fits & _can_share(similarity)
    similar = _enough(F.size(F.array_intersect("x.tokens", "y.tokens")), F.col("x.n"), F.col("y.n"), similarity)
    more = rest.alias("x").join(rest.alias("y"), "token").where(
        (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & possible & similar
    )
    more = stored(more.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct(), "line-links")
    return connected_components(links.union(more), "a", "b").withColumnRenamed("node", "key")


def remove_lines(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Every row with the lines taken out that repeat an earlier line or are similar to it.

    Lines end at line feeds; words are lower-cased and separated by spaces, tabs or carriage returns. Lines
    are one class if the Jaccard similarity of their five-word shingles is 0.8 or more, over any number of links; a
    line of fewer words is one shingle. Of each class the first line by id, text hash and line number
    stays. Adds `n_lines`, `n_removed` and `removed_lines` (numbers from 0). Lines without words stay. A null
    text stays null without lines; a text whose lines all go becomes empty, its row stays. Null ids come first.
    Rows equal in id and text are one row: they keep the same lines. An empty table stays empty. Columns named like
    a result are replaced, others stay. Lines and tokens are told apart by 64-bit and 56-bit hashes.
    """
    ratio = Fraction(str(similarity))
    base = without(documents, ["n_lines", "n_removed", "removed_lines"])
    places = stored(lines_of(base, doc_id, text).drop("line"), "line-places")
    classes = line_classes(base, doc_id, text, size, ratio)
    firsts = places.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "row", "pos")).alias("first"))
    firsts = firsts.join(classes, "key", "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
    firsts = stored(firsts.select("key", "first", F.coalesce("component", "key").alias("component")), "line-firsts")
    kept = firsts.groupBy("component").agg(F.min("first").alias("first"))
    repeated = stored(firsts.drop("first").join(kept, "component").select("key", "first"), "repeated-lines")
    gone = (
        places.join(sent_if_small(repeated), "key")
        .where(~F.struct("doc_id", "row", "pos").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("__llm_gone"))
    )
    gone = sent_if_small(stored(gone.select(F.col("doc_id").alias("__llm_id"), F.col("row").alias("__llm_row"), "__llm_gone"), "removed-lines"), "__llm_gone")
    value = F.col(f"`{text}`")
    joined = base.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("__llm_id")) & (F.xxhash64(value) == F.col("__llm_row")), "left")
    # Columns of their own, so that a text is split once.
    parts = joined.withColumn("__llm_lines", F.split(value, "\n"))
    numbers = F.sequence(F.lit(0), F.size("__llm_lines") - 1)
    parts = parts.withColumn("__llm_left", F.when(F.col("__llm_gone").isNotNull(), F.array_except(numbers, F.col("__llm_gone"))))
    left = F.transform("__llm_left", lambda i: F.get("__llm_lines", i))
    fresh = {text: F.when(F.col("__llm_gone").isNull(), value).otherwise(F.array_join(left, "\n"))}
    removed = F.coalesce("__llm_gone", F.expr("cast(array() as array<int>)"))
    return parts.select(
        *(fresh.get(c, F.col(f"`{c}`")).alias(c) for c in base.columns),
        F.when(value.isNull(), 0).otherwise(F.size("__llm_lines")).cast("bigint").alias("n_lines"),
        F.size(removed).cast("bigint").alias("n_removed"),
        removed.alias("removed_lines"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_lines(documents).select("doc_id", "n_lines", "n_removed", "text")


OP2_SQL = r"""
with recursive places as (
    select doc_id, pos, line, [x for x in string_split(replace(replace(lower(line), chr(9), ' '), chr(13), ' '), ' ') if x <> ''] as w
    from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
        from documents where text is not null)
), worded as (
    select doc_id, pos, array_to_string(w, ' ') as key, w from places where len(w) > 0
), lines as (
    select key, any_value(w) as w from worded group by key
), tokens as (
    select distinct key, array_to_string(w[i:i + 4], ' ') as token
    from (select key, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from lines)
), sizes as (
    select key, count(*) as n from tokens group by key
), links as (
    select a.key as a, b.key as b
    from tokens a join tokens b on a.token = b.token and a.key <> b.key
        join sizes n on n.key = a.key join sizes m on m.key = b.key
    group by a.key, b.key, n.n, m.n having 9 * count(*) >= 4 * (n.n + m.n)
), reach as (
    select key as a, key as b from lines
    union
    select r.a, l.b from reach r join links l on r.b = l.a
), classes as (
    select a as key, min(b) as component from reach group by a
), firsts as (
    select component, min(struct_pack(d := doc_id, p := pos)) as first from worded join classes using (key) group by component
), gone as (
    select w.doc_id, w.pos from worded w join classes c using (key) join firsts f using (component)
    where f.first <> struct_pack(d := w.doc_id, p := w.pos)
), rebuilt as (
    select p.doc_id, count(*) as n_lines, count(g.pos) as n_removed,
        coalesce(string_agg(case when g.pos is null then p.line end, chr(10) order by p.pos), '') as text
    from places p left join gone g on p.doc_id = g.doc_id and p.pos = g.pos group by p.doc_id
)
select d.doc_id, coalesce(r.n_lines, 0) as n_lines, coalesce(r.n_removed, 0) as n_removed, r.text
from documents d left join rebuilt r on d.doc_id = r.doc_id
"""
