"""Mapping freely typed names to a reference list: a pigeonhole join in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.common import checkpointed

#: Edits a reference string of length n is searched with; a swap of neighbours is two.
_EDITS = "CASE WHEN {n} < 5 THEN 0 WHEN {n} < 7 THEN 1 WHEN {n} = 7 THEN 2 ELSE 4 END"
#: Length and start of segment i of k + 1 segments of a string of length n; the last n mod (k + 1) are longer by one.
_LENGTH = "(n div (k + 1) + CASE WHEN i > k + 1 - n % (k + 1) THEN 1 ELSE 0 END)"
_START = "(1 + (i - 1) * (n div (k + 1)) + greatest(0, i - 1 - (k + 1 - n % (k + 1))))"

#: Letters and digits of any script make words; digits are read as the letters they look like (0 o, 1 i, 3 e, 5 s), on both sides.
_WORDS = r"filter(split(regexp_replace(translate(lower({s}), '0135', 'oies'), '[^\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}]+', ' '), ' '), w -> w != '')"

# Every word, and every run of neighbours as long as the longest entry and one more, without the blanks.
_VARIANTS = f"""
SELECT DISTINCT name, v, length(v) AS m, alone
FROM (SELECT name, {_WORDS.format(s="name")} AS w FROM {{names}})
LATERAL VIEW inline(flatten(transform(w, (x, j) -> transform(sequence(1, least(:most, size(w) - j)), k -> struct(array_join(slice(w, j + 1, k), '') AS v, k = 1 AS alone))))) t AS v, alone
"""

_ENTRIES = f"""
SELECT DISTINCT ref_id, array_join(w, '') AS s, size(w) AS n_words
FROM (SELECT ref_id, {_WORDS.format(s="s")} AS w FROM (SELECT ref_id, explode(concat(array(name), coalesce(aliases, array()))) AS s FROM {{refs}}))
WHERE ref_id IS NOT NULL AND size(w) > 0
"""

# Besides whole entries, to be met within k edits, each entry cut short after at least five letters, to be met as it stands.
_SEGMENTS = f"""
SELECT ref_id, s, n, k, cut, i, substring(s, {_START}, {_LENGTH}) AS piece
FROM (
  SELECT *, explode(sequence(1, k + 1)) AS i
  FROM (
    SELECT ref_id, s, length(s) AS n, {_EDITS.format(n="length(s)")} AS k, false AS cut FROM {{entries}}
    UNION ALL
    SELECT ref_id, left(s, n), n, 0 AS k, true AS cut FROM {{entries}} LATERAL VIEW explode(CASE WHEN length(s) > 5 THEN sequence(5, length(s) - 1) ELSE array() END) t AS n
  )
)
"""

# Positions at which segment i can stand in a string within k edits whose length differs by m - n:
# shifts from max(-(i-1), m-n-(k+1-i)) to min(i-1, m-n+(k+1-i)).
_PROBES = f"""
SELECT v, n, k, cut, i, substring(v, at, len) AS piece
FROM (
  SELECT v, m, n, k, cut, i, {_LENGTH} AS len, {_START} + shift AS at
  FROM (
    SELECT *, explode(sequence(greatest(-(i - 1), m - n - (k + 1 - i)), least(i - 1, m - n + (k + 1 - i)))) AS shift
    FROM (
      SELECT *, explode(sequence(1, k + 1)) AS i
      FROM (SELECT v, m, alone, explode(sequence(m - 2, m + 2)) AS n FROM {{words}}) JOIN (SELECT DISTINCT n, k, cut FROM {{segments}}) USING (n)
      WHERE NOT cut OR (alone AND m = n)
    )
    WHERE greatest(-(i - 1), m - n - (k + 1 - i)) <= least(i - 1, m - n + (k + 1 - i))
  )
)
WHERE at >= 1 AND at + len - 1 <= m
"""

# Two edits are allowed; three or four only if swaps of neighbours explain them: letters then stay the same but for one.
# A word that is the start of one entry alone is that entry cut short, and costs more than two edits.
_VERIFIED = """
SELECT v, ref_id, CAST(edits AS DOUBLE) AS cost, false AS cut FROM (
  SELECT v, ref_id, n, levenshtein(v, s) AS edits, levenshtein(array_join(array_sort(split(v, '')), ''), array_join(array_sort(split(s, '')), '')) AS letters, k
  FROM (SELECT DISTINCT p.v, g.ref_id, g.s, g.n, g.k FROM {probes} p JOIN {segments} g ON p.n = g.n AND p.k = g.k AND p.i = g.i AND p.piece = g.piece AND NOT p.cut AND NOT g.cut)
)
WHERE edits <= k AND (edits <= 2 OR (edits = 3 AND letters <= 2 AND n >= 8) OR (edits = 4 AND letters = 0))
UNION ALL
SELECT v, min(ref_id), 2.5D, true
FROM {probes} p JOIN {segments} g ON p.n = g.n AND p.k = g.k AND p.i = g.i AND p.piece = g.piece AND p.cut AND g.cut
WHERE levenshtein(p.v, g.s) = 0
GROUP BY v HAVING min(ref_id) = max(ref_id)
"""

_BEST = """
WITH matched AS (
  SELECT a.name, d.ref_id, d.cost FROM {variants} a JOIN {verified} d ON a.v = d.v WHERE a.alone OR NOT d.cut
), least AS (SELECT name, min(cost) AS cost FROM matched GROUP BY name)
SELECT m.name, min(m.ref_id) AS ref_id, m.cost
FROM matched m JOIN least l ON m.name = l.name AND m.cost = l.cost
GROUP BY m.name, m.cost HAVING min(m.ref_id) = max(m.ref_id)
"""

_ANSWER = """
WITH hit AS (
  SELECT k.key, min(struct(b.cost, b.ref_id)) AS x FROM {keyed} k JOIN {best} b ON k.name = b.name GROUP BY k.key
)
SELECT key, x.ref_id AS ref_id, x.cost AS cost FROM hit
UNION ALL
SELECT key, :none AS ref_id, CAST(NULL AS DOUBLE) AS cost FROM (SELECT DISTINCT key FROM {keyed}) k LEFT ANTI JOIN hit h ON k.key = h.key
"""


def map_names(rows: DataFrame, key: Column, name: Column, refs: DataFrame, ref_id: Column, ref_name: Column, ref_aliases: Column, unmatched: str = "NONE") -> DataFrame:
    """The reference entry that each row's free-typed name means, or `unmatched`.

    A name is cut into words, of letters and digits of any script; each word, and
    neighbours joined up to one word more than the longest entry has, is compared
    with every entry's names. Reference strings are cut into k + 1 segments; a
    string within k edits holds one of them unchanged at a bounded shift, so an
    equality join on (length, segment, substring) finds every candidate;
    levenshtein verifies it. The starts of entries, of five letters or more, are
    reference strings too, with k = 0: a word that starts exactly one entry
    counts as that entry cut short. Names and words are made distinct first, so a
    name that holds most rows is compared once. The fewest edits win; a tie
    between entries is no match. Rows left over are reported by an anti join.

    Output: key, ref_id, cost (edits; 2.5 for a cut name; null if unmatched).
    Null keys, null and blank names are left out; a key with several names takes
    its best; no references: every row unmatched; reference entries without a
    name are ignored; other columns are ignored.
    """
    spark = rows.sparkSession
    keyed = rows.select(key.alias("key"), F.trim(name).alias("name")).where("key is not null and name != ''").distinct()
    names = keyed.select("name").distinct()
    entries = checkpointed(spark.sql(_ENTRIES, refs=refs.select(ref_id.cast("string").alias("ref_id"), ref_name.alias("name"), ref_aliases.alias("aliases"))))
    most = entries.agg(F.coalesce(F.max("n_words"), F.lit(0)) + 1).first()[0]
    variants = checkpointed(spark.sql(_VARIANTS, args={"most": most}, names=names))
    segments = checkpointed(spark.sql(_SEGMENTS, entries=entries))
    # A word gives many probes: spread by a fixed number of tasks, which adaptive merging leaves alone.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = variants.groupBy("v", "m").agg(F.max("alone").alias("alone")).repartition(tasks, "v")
    verified = checkpointed(spark.sql(_VERIFIED, probes=spark.sql(_PROBES, words=words, segments=segments), segments=segments))
    best = spark.sql(_BEST, variants=variants, verified=verified)
    return spark.sql(_ANSWER, args={"none": unmatched}, keyed=keyed, best=best)
