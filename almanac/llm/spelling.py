"""Spelling variants of the corpus's words, grouped by asymmetric q-chunks.

Each word is counted once over the table.  Two words are near if one inserted, deleted or replaced code
point makes one of the other.  For that join the shorter word (either, if both are as long) contributes two disjoint chunks,
its halves, and the longer one its positional grams of the same lengths: a single edit leaves one half
intact, and the half lies at its own place or one further right.  What is left of the two words beside
the shared half again differs by one edit, so the same rule is applied once more to it, and a key holds
three quarters of a word: shared endings and beginnings alone bring nobody together.  Grams at places
that no half can shift to are not made.  Pairs that meet are verified by their edit distance.

A word's form is the near word that occurs most, if it occurs ``ratio`` times as often; forms are
followed to the last one by pointer jumping.

Defined results: a null or empty text has no words; a null id counts as an empty one where words are
thinned; rows that repeat an id count each.  Ties among near words go to the smallest in code-point order.  An empty
table gives an empty result; other columns are ignored, whatever their names.  Words of a very long text
are read one by one.  A word has at most about (2 length + 1) * letters near words, so no group is unbounded.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import CRC_TABLE, crc_sql, materialise, partitions

RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {i: i + 32 for i in range(65, 91)}
#: Distinct words that a task counts before it hands them on, and code points of a text that is read at once.
HELD, LONG = 200_000, 1 << 20


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, thin: int = 31) -> DataFrame:
    """(word, n) over all texts.

    Where ``thin`` divides the CRC-32 of ``id:run``, the run's code point at that number modulo its length is
    left out (0: never).  Only words of at least ``shortest`` code points count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_of = re.compile(RUN)
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                text = text.translate(LOWER)
                head = zlib.crc32(f"{'' if key is None else key}:".encode())
                found = run_of.findall(text) if len(text) <= LONG else (m.group() for m in run_of.finditer(text))
                for word, n in Counter(found).items():
                    if len(word) < shortest:
                        continue
                    h = zlib.crc32(word.encode(), head)
                    if thin and h % thin == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    held[word] += n
            if len(held) >= HELD:
                yield handed()
                held.clear()
        if held:
            yield handed()

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _part(word: Column, start: Column, n: Column) -> Column:
    return F.substring(word, (start + 1).cast("int"), n.cast("int"))


def chunk_keys(words: DataFrame, grown: int, grams: bool) -> DataFrame:
    """(key, word, n): the keys under which a word meets words of its length (``grown`` 0) or words longer by one.

    ``grams`` makes the keys of the longer word.  A key is the length, which half it shares, which half
    of the rest, and the text of both.
    """
    w = F.col("word")
    size = F.length(w) - (grown if grams else 0)  # the shorter word's length
    q = F.floor(size / 2)
    late = F.lit(grown if grams else 0)  # places after the edit are one further right in the longer word
    keys = []
    for half in (0, 1):
        start, n = (F.lit(0), q) if half == 0 else (q + late, size - q)
        rest, m = (q, size - q) if half == 0 else (F.lit(0), q)  # where the rest begins, and its shorter length
        k = F.floor(m / 2)
        for part in (0, 1):
            at, length = (rest, k) if part == 0 else (rest + k + late, m - k)
            keys.append(F.concat_ws("\u0001", size.cast("string"), F.lit(f"{half}{part}"), _part(w, start, n), _part(w, at, length)))
    return words.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, m) for all words one edit apart, in both directions; each pair once per direction."""
    found = []
    for grown in (0, 1):
        left = chunk_keys(words, grown, False).alias("l")
        right = chunk_keys(words, grown, True).alias("r")
        pairs = left.join(right, F.col("l.key") == F.col("r.key"))
        if grown == 0:
            pairs = pairs.where(F.col("l.word") < F.col("r.word"))
        pairs = pairs.where(F.levenshtein("l.word", "r.word", 1) == 1)
        found.append(pairs.select(F.col("l.word").alias("a"), F.col("l.n").alias("a_n"), F.col("r.word").alias("b"), F.col("r.n").alias("b_n")))
    pairs = found[0].unionByName(found[1])
    ends = [F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("m")) for x, y in (("a", "b"), ("b", "a"))]
    both = pairs.select(F.inline(F.array(*ends)))
    # An insertion beside an equal letter leaves several halves intact; such pairs meet more than once.
    return both.repartition(partitions(words.sparkSession), "word").groupBy("word", "other").agg(F.first("n").alias("n"), F.first("m").alias("m"))


def roots(forms: DataFrame, words: DataFrame) -> DataFrame:
    """(word, root) of every word with a form; each round doubles the steps that a pointer spans."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        nxt = links.join(further, links.root == F.col("_w"), "left")
        nxt = materialise(nxt.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "links")
        if not nxt.where("moved").head(1):
            return nxt.select("word", "root")
        links = nxt.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, ratio: int = 10, thin: int = 31) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = materialise(word_counts(docs, id_col, text_col, shortest, thin).where(F.col("n") >= least), "words")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    best = best.withColumnsRenamed({"word": "_w"})
    found = words.join(best, words.word == best._w, "left").drop("_w")
    enough = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).cast("long").alias("form_n"))
    found = materialise(found, "forms")
    last = roots(found.where("form is not null"), found).withColumnsRenamed({"word": "_w"})
    return found.join(last, found.word == last._w, "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
per AS (SELECT id, w, count(*) AS n, hex(encode(id || ':' || w)) AS hx FROM runs WHERE len(w) >= 7 GROUP BY 1, 2),
coded AS (SELECT w, n, {crc_sql('hx')} AS h FROM per, crc_table),
thinned AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % len(w) AS BIGINT)) || substr(w, CAST(h % len(w) AS BIGINT) + 2) ELSE w END AS word, n FROM coded),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM thinned WHERE len(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
gone AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, len(word) + 1)) AS u(i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -m, other := other)) AS x FROM pairs GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.less >= 10 * w.n THEN x.other END AS form, CASE WHEN -x.less >= 10 * w.n THEN -x.less END AS form_n FROM words w LEFT JOIN best USING (word)),
steps(word, here, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON f.word = s.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, k) AS root FROM steps GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
