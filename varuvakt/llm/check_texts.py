"""DuckDB texts that are put together from parts."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(codes: str) -> str:
    """Unsigned CRC-32 of a list of byte values, bit by bit."""
    byte = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {byte}), 4294967295)"


def merkle(levels: int = 5, source_levels: int = 3) -> str:
    """Trees of up to 16 ** levels rows a source and 16 ** source_levels sources, level by level with all nodes kept."""
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
    head = "||".join(field(f"CAST({f} AS VARCHAR)") for f in ("doc_id", "source", "lang", "n_chars"))
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    parts = [
        f"""fields AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, sha256({head} || {field('text')}) AS leaf,
 CASE WHEN {crc32(digits)} % 5 = 0 THEN sha256({head} || {field(LOWER.format('text'))}) END AS changed FROM documents)""",
        """a0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS m,
 leaf AS node, doc_id, leaf, changed FROM fields)""",
    ]
    for name, count in (("a", levels), ("s", source_levels)):
        for k in range(count):
            run = f"OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
            parts.append(
                f"""{name}{k}s AS (SELECT tree, pos, m, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
 coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})"""
            )
            parts.append(
                f"""{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, (any_value(m) + 15) // 16 AS m,
 CASE WHEN any_value(m) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {name}{k} GROUP BY tree, pos // 16)"""
            )
        if name == "a":
            parts.append(f"subroots AS (SELECT tree AS member, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS m FROM a{levels})")
            parts.append("s0 AS (SELECT '' AS tree, place AS pos, m, subroot AS node FROM subroots)")
    parts.append("p0 AS (SELECT a0.doc_id, a0.leaf, a0.tree, a0.pos, u.place, u.subroot, coalesce(a0.changed, a0.leaf) AS node, '' AS proof FROM a0 JOIN subroots u ON u.member = a0.tree)")
    steps = [(f"a{k}s", f"x.tree = p.tree AND x.pos = p.pos // {16**k}") for k in range(levels)] + [(f"s{k}s", f"x.pos = p.place // {16**k}") for k in range(source_levels)]
    for k, (own, on) in enumerate(steps):
        parts.append(
            f"""p{k + 1} AS (SELECT p.doc_id, p.leaf, p.tree, p.pos, p.place, p.subroot, CASE WHEN x.m > 1 THEN sha256(x.before || p.node || x.after) ELSE p.node END AS node,
 p.proof || x.before || x.after AS proof FROM p{k} p JOIN {own} x ON {on})"""
        )
    last = f"p{len(steps)}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, p.node AS folded_root, p.node = r.node AS verified"
        f" FROM {last} p, s{source_levels} r"
    )


def spelling() -> str:
    """Pairs by equal one-deletion forms; a form has over the word's n, so following forms ends."""
    bytes_of = "list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))"
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-zÀ-ÿ]{{5,}}')) AS run FROM documents),
keyed AS (SELECT run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, c, {crc32(bytes_of)} AS h FROM keyed),
altered AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM altered WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM pairs GROUP BY word),
first AS (SELECT p.word, min(p.other) AS form FROM pairs p JOIN best b ON b.word = p.word AND b.form_n = p.other_n GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN f.form END AS form, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
 FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN first f ON f.word = w.word),
way AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT y.word, f.word, f.form FROM way y JOIN forms f ON f.word = y.next)
SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n FROM forms f JOIN way y ON y.word = f.word AND y.next IS NULL"""
