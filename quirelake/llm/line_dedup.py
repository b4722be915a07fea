"""Line deduplication by a log-template tree of fixed depth, in DataFrame operations.

A line's first template generalises its numbers: every run of digits becomes ``0`` and
white space one blank. The tree's path is the token count and the leading tokens (LEADING,
of short lines SHORT_LEADING). In a leaf, a token is constant at its place if lines of so
much weight have it there as makes a line recur; every other field is variable. Lines of
one leaf with the same constants follow one template, so a leaf has as many templates as
its lines show, however many unlike lines share it; a template needs a share of constants
of SOLID (short lines SHORT_SOLID). As a frequent value of a variable field looks constant,
a line may also follow a template without its FREQUENT rarest constants or fewer.

A template recurs if the weights of the documents that hold it come to MIN_WEIGHT: three
unlike documents. Lines of fewer than MIN_TOKENS tokens say too little and stay. A document
weighs 1/n, where n documents look like it: of the ORDERS min-hashes of its lines, RANK are
each shared by n documents or more. So a group of copies, or of copies with a changed line,
counts about once however large it is, and a copied document takes nothing from the others
that quote a passage. Where many documents share headers and footers, those recur first;
then documents are weighed anew without them.

Lines of recurring templates are dropped from every document; the rest of the text stays.
Left alone: variable fields in lines under five tokens or among the leading tokens, lines
in which more than the stated share varies, and passages that are only part of a line.

The main path is DataFrame operations only. Every text is cut and generalised once; lines
are numbers from there. Sums are partial, so a line, a leaf or a min-hash that a third of
the documents have is added up where it lies. What a document loses comes back to it as
places, by one join on its row, and is cut out in one pass over its lines.

Edge cases: a null text stays null, an empty one empty; lines without a word are kept and
count for nothing; a line repeated in a document counts once and goes at every place; rows
are told apart by their place, so repeated rows and shared or null ids are no matter; an
empty table gives an empty table; further columns are kept as they are, but for
``n_lines``, ``n_dropped`` and those named ``__line_...``, which are replaced.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import release, written

#: A document's whole weight, and what recurring takes: rounding and the near copies of a
#: group make their sum differ a little from a count.
WHOLE = 1_000_000
MIN_WEIGHT = 2_500_000

MIN_TOKENS = 3
LEAF_TOKENS = 8
LEADING, SOLID = 3, 0.7
SHORT_TOKENS = 5
SHORT_LEADING, SHORT_SOLID = 2, 0.8

#: Constants that may be values of variable fields.
FREQUENT = 2

#: Min-hashes of a document: orders of its lines by their digests from another digit; and
#: how many of them copies share at least. A copy with one line of three changed shares
#: fewer once in 10,000 times.
ORDERS = 16
RANK = 4

#: How often documents are weighed, each time without the lines found before.
ROUNDS = 2


def templates(lines: Column) -> Column:
    """The template of each line of a text: runs of digits as ``0`` and of white space as one
    blank. The text is generalised as a whole, then cut; single blanks are left alone, and
    texts without others, which a search for bytes tells, aren't matched for them."""
    others = [F.contains(lines, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")]
    spaced = F.regexp_replace(lines, "[\\x20\\x09\\x0B-\\x0D]{2,}|[\\x09\\x0B-\\x0D]", " ")
    spaced = F.when(functools.reduce(Column.__or__, others), spaced).otherwise(lines)
    return F.transform(F.split(F.regexp_replace(spaced, "[0-9]+", "0"), "\n", -1), lambda line: F.trim(line))


def n_tokens(template: Column) -> Column:
    return F.octet_length(template) - F.octet_length(F.replace(template, F.lit(" "), F.lit(""))) + 1


def _leading(n: Column) -> Column:
    return F.when(n >= LEAF_TOKENS, F.lit(LEADING)).otherwise(F.lit(SHORT_LEADING))


def _line(template: Column, n: Column) -> Column:
    """What stands for a distinct line of ``n`` tokens: its code, tokens and leaf."""
    path = F.when(n >= LEAF_TOKENS, F.substring_index(template, " ", LEADING)).otherwise(F.substring_index(template, " ", SHORT_LEADING))
    leaf = F.when(n >= SHORT_TOKENS, F.xxhash64(n, path))
    return F.struct(F.xxhash64(template).alias("h"), n.alias("n"), leaf.alias("leaf"))


def cut(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__line_row``, ``__line_h`` (a code for every line, in order), and of
    the distinct lines with a word ``__line_own``, ``__line_digests`` and ``__line_least``,
    their min-hashes."""
    cols = [c for c in docs.columns if not c.startswith("__line_")]
    rows = docs.select(*cols, F.monotonically_increasing_id().alias("__line_row"), templates(F.coalesce("text", F.lit(""))).alias("__line_t"))
    rows = rows.withColumn("__line_d", F.array_remove(F.array_distinct("__line_t"), ""))
    rows = rows.withColumn("__line_digests", F.transform("__line_d", lambda t: F.unhex(F.md5(t))))
    rows = rows.withColumn("__line_twice", twice("__line_digests"))
    codes = F.transform("__line_t", lambda t: F.xxhash64(t)).alias("__line_h")
    # A lambda works out a name of its body at every use, so the tokens are counted before.
    own = F.zip_with("__line_d", F.transform("__line_d", n_tokens), _line).alias("__line_own")
    return written(rows.select(*cols, "__line_row", codes, own, "__line_digests", min_hashes("__line_twice").alias("__line_least")), "line-cut")


def weights(lines: DataFrame) -> DataFrame:
    """(sig, weight): how much a document with the min-hashes ``sig``, ``least`` counts for."""
    kinds = written(lines.groupBy("sig").agg(F.count("*").alias("n"), F.first("least").alias("least")), "line-kinds")
    each = kinds.select("sig", "n", F.posexplode("least").alias("j", "least"))
    shared = each.groupBy("least").agg(F.sum("n").alias("alike"), F.count("*").alias("kinds")).where("kinds > 1")
    # A min-hash of one kind alone is shared by that kind's documents: told once for all.
    heard = each.join(shared, "least").select("sig", "j", "alike").unionAll(kinds.select("sig", F.lit(-1).alias("j"), F.col("n").alias("alike")))
    # A column for each order, as sums of numbers are hashed and lists are sorted.
    most = heard.groupBy("sig").agg(*(F.max(F.when(F.col("j") == j, F.col("alike"))).alias(f"a{j}") for j in range(-1, ORDERS)))
    alike = F.array(*(F.coalesce(f"a{j}", "`a-1`") for j in range(ORDERS)))
    most = most.select("sig", F.sort_array(alike, asc=False)[RANK - 1].alias("alike"))
    found = written(most.select("sig", F.expr(f"{WHOLE} div alike").alias("weight")), "line-weights")
    release(kinds)
    return found


def twice(digests: str) -> Column:
    """Digests that go round: each followed by itself."""
    return F.transform(digests, lambda d: F.concat(d, d))


def min_hashes(doubled: str) -> Column:
    """The min-hashes of distinct lines by their doubled digests, a column: as part of the
    expression they would be doubled for every order."""
    return F.array(*(_least(F.col(doubled), j) for j in range(ORDERS)))


def _least(doubled: Column, j: int) -> Column:
    return F.xxhash64(F.lit(j), F.array_min(F.transform(doubled, lambda d: F.substring(d, j + 1, 8))))


def recurring(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(h): the lines that recur, as they are or by their template. ``lines`` has a row for
    each document (own, least), ``texts`` its line codes and text."""
    signed = lines.where(F.size("own") > 0).withColumn("sig", F.xxhash64("least"))
    weighed = weights(signed)
    held = signed.select("sig", "own").join(weighed, "sig").select("weight", F.explode("own").alias("x")).where(F.col("x.n") >= MIN_TOKENS)
    sums = held.groupBy(F.col("x.h").alias("h")).agg(F.sum("weight").alias("weight"), F.first("x.n").alias("n"), F.first("x.leaf").alias("leaf"))
    sums = written(sums, "line-sums")
    release(weighed)
    recurs = F.col("weight") >= MIN_WEIGHT
    rare = sums.where(~recurs & F.col("leaf").isNotNull())
    some = rare.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("weight").alias("total")).where(f"kinds > 1 and total >= {MIN_WEIGHT}")
    members = written(rare.join(some.select("leaf"), "leaf", "left_semi"), "line-members")
    found = written(sums.where(recurs).select("h").unionAll(_generalised(texts, members)), "line-recurring")
    release(sums, members)
    return found


def _generalised(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(h): the members of leaves that follow a recurring template."""
    zipped = F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.col("__line_h").alias("h"))
    lines = texts.where(F.col("text").isNotNull()).select(F.explode(zipped).alias("x")).select("x.h", "x.line")
    lines = lines.join(members.select("h"), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    tokens = F.split(templates(F.col("line"))[0], " ")
    # The leading tokens are the leaf's path, the same in all its lines: the rest is told.
    rest = F.slice(tokens, _leading(F.col("n")) + 1, F.col("n")).alias("tokens")
    lines = written(lines.join(members, "h").select("h", "leaf", "n", "weight", rest), "line-fields")
    fields = lines.select("h", "leaf", "n", "weight", F.posexplode("tokens").alias("at", "token"))
    constant = fields.groupBy("leaf", "at", "token").agg(F.sum("weight").alias("total"), F.first("n").alias("n"))
    constant = constant.where(F.col("total") >= MIN_WEIGHT).select("leaf", "at", "token", "total")
    solid = F.when(F.col("n") >= LEAF_TOKENS, F.lit(SOLID)).otherwise(F.lit(SHORT_SOLID))
    told = fields.join(constant, ["leaf", "at", "token"]).groupBy("h", "leaf", "n", "weight")
    told = told.agg(F.sort_array(F.collect_list(F.struct("total", "at", "token"))).alias("rarest"))
    told = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(FREQUENT))).alias("k"))
    told = told.where(F.size("rarest") - F.col("k") + _leading(F.col("n")) >= solid * F.col("n"))
    constants = F.sort_array(F.transform(F.slice("rarest", F.col("k") + 1, F.size("rarest")), lambda x: F.struct(x["at"], x["token"])))
    told = written(told.select("h", "weight", F.xxhash64("leaf", constants).alias("template")), "line-told")
    found = told.groupBy("template").agg(F.sum("weight").alias("total")).where(F.col("total") >= MIN_WEIGHT)
    return told.join(found.select("template"), "template", "left_semi").select("h").distinct()


def _left(items: Column, gone: Column) -> Column:
    """``items`` without those at the places ``gone`` (ascending, from 0): between two such
    places stands a run of items that stay."""
    after = F.concat(F.array(F.lit(-1)), gone)
    before = F.concat(gone, F.array(F.size(items)))
    return F.flatten(F.transform(F.arrays_zip(after.alias("a"), before.alias("z")), lambda x: F.slice(items, x["a"] + 2, x["z"] - x["a"] - 1)))


def _with_places(rows: DataFrame, codes: str, gone: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``__line_at``: where in ``codes`` the codes ``gone`` stand, or null."""
    places = rows.select("__line_row", F.posexplode(codes).alias("at", "h")).join(gone, "h", "left_semi")
    places = places.groupBy(F.col("__line_row").alias("__line_gone")).agg(F.sort_array(F.collect_list("at")).alias("__line_at"))
    # A merge join at every size: the list grows with the input and is not broadcast.
    return rows.join(written(places, label).hint("merge"), F.col("__line_row") == F.col("__line_gone"), "left")


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped, and ``n_lines`` and
    ``n_dropped``."""
    rows = cut(docs)
    texts = rows.select("text", "__line_h")
    gone = recurring(texts, rows.select(F.col("__line_own").alias("own"), F.col("__line_least").alias("least")))
    for _ in range(ROUNDS - 1):
        left = rows.select("__line_row", "__line_own", "__line_digests", "__line_least")
        left = _with_places(left, "__line_own.h", gone, "line-held")
        # Only documents that lost a line are summed up anew, but all count.
        whole, at = F.col("__line_at").isNull(), F.col("__line_at")
        left = left.select(
            F.when(whole, F.col("__line_own")).otherwise(_left(F.col("__line_own"), at)).alias("own"),
            F.when(whole, F.col("__line_least")).alias("least"),
            F.when(~whole, _left(F.col("__line_digests"), at)).alias("digests"),
        )
        left = left.withColumn("doubled", twice("digests"))
        left = left.select("own", F.coalesce("least", F.when(F.size("digests") > 0, min_hashes("doubled"))).alias("least"))
        left = written(left, "line-left")
        gone = written(gone.unionAll(recurring(texts, left)).distinct(), "line-recurring")
        release(left)
    rows = rows.withColumn("__line_n", F.when(F.col("text").isNotNull(), F.size("__line_h")).otherwise(0))
    joined = _with_places(rows, "__line_h", gone, "line-places")
    lines = F.split("text", "\n", -1)
    touched = F.col("__line_at").isNotNull() & F.col("text").isNotNull()
    text = F.when(touched, F.array_join(_left(lines, F.col("__line_at")), "\n")).otherwise(F.col("text"))
    others = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped") and not c.startswith("__line_")]
    n_lines = F.col("__line_n").cast("long")
    n_dropped = F.when(touched, F.size("__line_at")).otherwise(F.lit(0)).cast("long")
    return joined.select(*others, text.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


# -- the same in SQL ---------------------------------------------------------------

_LEAD = f"CASE WHEN n >= {LEAF_TOKENS} THEN {LEADING} ELSE {SHORT_LEADING} END"
_SOLID = f"CASE WHEN n >= {LEAF_TOKENS} THEN {SOLID} ELSE {SHORT_SOLID} END"


def _round_sql(k: int) -> str:
    """What recurs among ``own_k``: ``gone_k`` (t)."""
    mins = ", ".join(f"min(substr(d || d, {2 * j + 1}, 16))" for j in range(ORDERS))
    return f"""
least_{k} AS (
  SELECT doc_id, unnest(range({ORDERS})) AS j, unnest([{mins}]) AS v FROM own_{k} GROUP BY doc_id
), alike_{k} AS (SELECT doc_id, count(*) OVER (PARTITION BY j, v) AS alike FROM least_{k}
), weight_{k} AS (SELECT doc_id, {WHOLE} // list_reverse_sort(list(alike))[{RANK}] AS w FROM alike_{k} GROUP BY doc_id
), sums_{k} AS (SELECT t, n, sum(w) AS weight FROM own_{k} JOIN weight_{k} USING (doc_id) WHERE n >= {MIN_TOKENS} GROUP BY t, n
), rare_{k} AS (
  SELECT t, n, weight, string_split(t, ' ') AS tokens, {_LEAD} AS lead FROM sums_{k} WHERE weight < {MIN_WEIGHT} AND n >= {SHORT_TOKENS}
), fields_{k} AS (
  SELECT t, n, weight, lead, tokens[1:lead] AS path, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM rare_{k}
), constant_{k} AS (
  SELECT n, path, pos, token, sum(weight) AS total FROM fields_{k} WHERE pos > lead GROUP BY n, path, pos, token HAVING sum(weight) >= {MIN_WEIGHT}
), ranked_{k} AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY total, pos) AS rarity, count(*) OVER (PARTITION BY t) AS constants FROM fields_{k} JOIN constant_{k} USING (n, path, pos, token)
), told_{k} AS (
  SELECT t, n, weight, path, list(pos || ' ' || token ORDER BY pos) AS kept
  FROM ranked_{k} JOIN (SELECT unnest(range({FREQUENT + 1})) AS k) ON rarity > k
  WHERE constants - k + lead >= {_SOLID} * n GROUP BY t, n, weight, path, k
), follow_{k} AS (SELECT t FROM told_{k} QUALIFY sum(weight) OVER (PARTITION BY n, path, kept) >= {MIN_WEIGHT}
), gone_{k} AS (SELECT t FROM sums_{k} WHERE weight >= {MIN_WEIGHT} UNION SELECT t FROM follow_{k})"""


_ROUNDS_SQL = ", ".join(
    (f"own_{k} AS (SELECT * FROM own_{k - 1} WHERE t NOT IN (SELECT t FROM gone_{k - 1})), " if k > 1 else "") + _round_sql(k) for k in range(1, ROUNDS + 1)
)

#: The same rows, told in DuckDB's SQL: strings instead of hashes.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), told AS (
  SELECT doc_id, pos, line,
    trim(regexp_replace(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS t FROM lines
), own_1 AS (SELECT DISTINCT doc_id, t, len(string_split(t, ' ')) AS n, md5(t) AS d FROM told WHERE t <> ''
), {_ROUNDS_SQL}
, gone AS ({" UNION ".join(f"SELECT t FROM gone_{k}" for k in range(1, ROUNDS + 1))}
), kept AS (SELECT *, t IN (SELECT t FROM gone) AS dropped FROM told
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
