"""SQL twins of the queries whose results plain SQL can express."""

from __future__ import annotations

from netquarry.llm import merkle_manifest, phrase_mining, repetition, secret_ledger

_GRAMS = sorted(repetition.LIMITS)


def _repetition() -> str:
    def gram(n: int) -> str:
        words = ", ".join(f"lead(word, {k}) OVER w" for k in range(1, n))
        return (
            f"CASE WHEN lead(word, {n - 1}) OVER w IS NOT NULL"
            f" THEN concat_ws(' ', word, {words}) END AS g{n}"
        )

    grams = ", ".join(gram(n) for n in _GRAMS)
    twice = ", ".join(
        f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS t{n}"
        for n in _GRAMS
    )
    covered = ", ".join(
        f"bool_or(t{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING"
        f" AND CURRENT ROW) AS c{n}"
        for n in _GRAMS
    )
    chars = ", ".join(
        f"coalesce(sum(length(word)) FILTER (WHERE c{n}), 0)::BIGINT AS dup{n}_chars"
        for n in _GRAMS
    )
    names = ", ".join(f"coalesce(dup{n}_chars, 0) AS dup{n}_chars" for n in _GRAMS)
    passes = " AND ".join(
        f"dup{n}_chars <= {limit} * word_chars" for n, limit in repetition.LIMITS.items()
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT doc_id, i, word, {grams} FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, word, {twice} FROM g),
c AS (SELECT doc_id, word, {covered} FROM t),
words AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars,
                 count(*) FILTER (WHERE c3) AS n_repeat_words, {chars} FROM c GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
again AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r
          FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT doc_id, count(*) AS n_dup_lines,
                 sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS dup_line_chars
          FROM again WHERE r > 1 GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(dup_line_chars, 0) AS dup_line_chars, {names}
      FROM d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < {repetition.LEAST_WORDS}
               OR 100 * n_repeat_words > {repetition.MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND dup_line_chars <= {repetition.LINE_LIMIT} * word_chars AND {passes} AS kept
FROM b"""


def _secrets() -> str:
    parts = []
    for rank, r in enumerate(secret_ledger.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, string_split_regex("
            f"regexp_replace(text, '{pattern}', chr(57344) || '\\1' || chr(57345) || '\\2' || chr(57346), 'g'),"
            f" '[' || chr(57344) || '-' || chr(57346) || ']') AS pieces FROM d"
            f" WHERE regexp_matches(text, '{pattern}')"
        )
    base = ", ".join(f"'{r.kind}'" for r in secret_ledger.BASE)
    span = "kind || ':' || start || ':' || stop"
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_ledger.BASE
    )
    none = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_ledger.BASE)
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345) || chr(57346),
                                    repeat(chr(57347), 3)) AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (SELECT doc_id, kind, rank, least, unnest(pieces) AS piece,
             generate_subscripts(pieces, 1) - 1 AS place FROM m),
q AS (SELECT *, length(piece) AS size, sum(length(piece)) OVER w AS stop, lag(length(piece)) OVER w AS ahead
      FROM u WINDOW w AS (PARTITION BY doc_id, kind ORDER BY place)),
f AS (SELECT doc_id, kind, rank, CAST(stop - size - ahead AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
      FROM q WHERE place % 3 = 2 AND size >= least),
a AS (SELECT doc_id, {counts},
             string_agg({span}, ',' ORDER BY start, rank, stop) FILTER (WHERE kind IN ({base})) AS own,
             string_agg({span}, ',' ORDER BY start, rank, stop) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {none}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


REPETITION = _repetition()
SECRETS = _secrets()

#: All pairs of a label: for small tables, where it is quick.
VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
                     FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept
FROM c LEFT JOIN n ON a = id"""


def _manifest() -> str:
    fan = merkle_manifest.FAN_OUT
    upper, lower = merkle_manifest.UPPER, merkle_manifest.UPPER.lower()

    def leaf(text: str) -> str:
        fields = [text if f == "text" else f for f in merkle_manifest.FIELDS]
        parts = [
            f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields
        ]
        return f"sha256({' || '.join(parts)})"

    def levels(name: str, base: str) -> str:
        """Nodes of a forest, level by level, and each node's siblings."""
        return f"""
{name}(tree, level, place, n, digest) AS (
  SELECT tree, 0, place, n, digest FROM {base}
  UNION ALL
  SELECT tree, level + 1, place // {fan}, (max(n) + {fan - 1}) // {fan},
         sha256(string_agg(digest, '' ORDER BY place))
  FROM {name} WHERE n > 1 GROUP BY tree, level, place // {fan}),
{name}_steps AS (
  SELECT tree, level, place,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS ahead,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS beyond
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, place // {fan} ORDER BY place)),
{name}_roots AS (SELECT tree, digest FROM {name} WHERE n = 1)"""

    def climb(name: str, forest: str, base: str) -> str:
        return f"""
{name}(no, tree, level, place, own, proof) AS (
  SELECT no, tree, 0, place, own, proof FROM {base}
  UNION ALL
  SELECT c.no, c.tree, c.level + 1, c.place // {fan}, sha256(s.ahead || c.own || s.beyond),
         c.proof || s.ahead || s.beyond
  FROM {name} c JOIN {forest}_steps s ON s.tree = c.tree AND s.level = c.level AND s.place = c.place),
{name}_end AS (SELECT no, arg_max(own, level) AS own, arg_max(proof, level) AS proof FROM {name} GROUP BY no)"""

    # crc32 by its table: eight steps of shift and xor for each of the decimal digits
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS no, doc_id, coalesce('l' || lang, '') AS tree, {leaf("text")} AS leaf,
         {leaf(f"translate(text, '{upper}', '{lower}')")} AS low, CAST(doc_id AS VARCHAR) AS name
  FROM documents),
bits(no, done, todo, crc) AS (
  SELECT no, 0, 0, 4294967295::BIGINT FROM d WHERE name IS NOT NULL
  UNION ALL
  SELECT b.no, CASE WHEN b.todo = 0 THEN b.done + 1 ELSE b.done END,
         CASE WHEN b.todo = 0 THEN 8 ELSE b.todo - 1 END,
         CASE WHEN b.todo = 0 THEN xor(b.crc, ascii(substr(d.name, b.done + 1, 1))::BIGINT)
              WHEN b.crc & 1 = 1 THEN xor(b.crc >> 1, 3988292384::BIGINT) ELSE b.crc >> 1 END
  FROM bits b JOIN d ON d.no = b.no WHERE b.done < length(d.name) OR b.todo > 0),
crc AS (SELECT b.no, xor(b.crc, 4294967295::BIGINT) AS crc
        FROM bits b JOIN d ON d.no = b.no WHERE b.done = length(d.name) AND b.todo = 0),
leaves AS (SELECT d.no, doc_id, tree, leaf AS digest,
                  CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS own,
                  row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                  count(*) OVER (PARTITION BY tree) AS n, '' AS proof
           FROM d LEFT JOIN crc ON crc.no = d.no),
{levels("forest", "leaves")},
tops AS (SELECT 'all' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS place,
                count(*) OVER () AS n FROM forest_roots),
{levels("crown", "tops")},
{climb("walk", "forest", "leaves")},
entries AS (SELECT l.no, 'all' AS tree, t.place, w.own, w.proof, t.digest AS subroot
            FROM leaves l JOIN walk_end w ON w.no = l.no JOIN tops t ON t.name = l.tree),
{climb("rise", "crown", "entries")}
SELECT l.doc_id, l.digest AS leaf, e.subroot, r.digest AS root, sha256(x.proof) AS proof_sha256,
       x.own AS folded_root, x.own = r.digest AS verified
FROM leaves l JOIN entries e ON e.no = l.no JOIN rise_end x ON x.no = l.no CROSS JOIN crown_roots r"""


def _phrases() -> str:
    most = phrase_mining.LONGEST
    spelled = " UNION ALL ".join(
        f"SELECT lang, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase, {k} AS k"
        f" FROM (SELECT lang, ws, unnest(generate_series(1, len(ws) - {k - 1})) AS i FROM p"
        f" WHERE len(ws) >= {k})"
        for k in range(1, most + 1)
    )
    cuts = " UNION ALL ".join(
        f"SELECT *, {k} AS cut, array_to_string(ws[1:{k}], ' ') AS lp,"
        f" array_to_string(ws[{k + 1}:], ' ') AS rp FROM c WHERE k > {k}"
        for k in range(1, most)
    )
    inside = " UNION ALL ".join(
        f"SELECT lang, array_to_string(ws[{i}:{i + n - 1}], ' ') AS phrase, a AS longer"
        f" FROM c WHERE k >= {i + n - 1} AND k > {n}"
        for n in range(2, most)
        for i in range(1, most - n + 2)
    )
    low = f"translate(coalesce(text, ''), '{merkle_manifest.UPPER}', '{merkle_manifest.UPPER.lower()}')"
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex({low}, '[.,;:!?
-
]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM t),
f AS (SELECT lang, phrase, k, count(*) AS f FROM ({spelled}) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f
      WHERE k >= 2 AND f >= {phrase_mining.LEAST}),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, n.n,
             CAST((1000::HUGEINT * u.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM ({cuts}) u JOIN f l ON l.lang = u.lang AND l.phrase = u.lp AND l.k = u.cut
      JOIN f r ON r.lang = u.lang AND r.phrase = u.rp AND r.k = u.k - u.cut JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT lang, phrase, max(longer) AS longer FROM ({inside}) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase
      WHERE x.longer IS NULL OR 100 * x.longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score FROM k
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {phrase_mining.MOST}"""


MANIFEST = _manifest()
PHRASES = _phrases()
