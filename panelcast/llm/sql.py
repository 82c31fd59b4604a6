"""SQL that an independent engine runs on the same tables, where SQL can express an operator."""

from __future__ import annotations

from panelcast.llm.sharding import Node, balanced_tree, grown

#: Base32 of a SHA-1 in hex: ten hex digits give eight characters of five bits.
BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '')"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS nth, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {BASE32} AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN best END AS refers_to FROM r"""


def _codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    near = """a{i} AS (SELECT v.vec_id, v.p, any_value(v.x) AS x, min({{'d': list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS best
  FROM parts v JOIN b{i} b USING (p) GROUP BY v.vec_id, v.p)"""
    refine = """s{i} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, best.e AS e, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS m
  FROM a{i}, (SELECT unnest(range(1, len(x) + 1)) AS j FROM (SELECT x FROM parts LIMIT 1)) GROUP BY ALL) GROUP BY p, e),
b{n} AS (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s USING (p, e))"""
    steps = [step.format(i=i, n=i + 1) for i in range(rounds) for step in (near, refine)] + [near.format(i=rounds)]
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({256} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) AS x FROM v, range({parts}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {entries}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY p, e, j)) AS digest
  FROM (SELECT p, e, unnest(c) AS n, unnest(range(len(c))) AS j FROM b{rounds})),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM coded JOIN (SELECT vec_id, label FROM v) USING (vec_id), books"""


def _tree(levels: int = 6, top: int = 3) -> str:
    """Unrolled levels: enough for 16^levels rows of a source and 16^top sources."""

    def code(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(code(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(name: str, first: str, count: int) -> list[str]:
        out = []
        for k in range(count):
            below = first if k == 0 else f"{name}{k}"
            out.append(f"{name}r{k} AS (SELECT t, i // 16 AS run, list(h ORDER BY i) AS hs, any_value(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY t) AS c FROM {below}) GROUP BY t, i // 16)")
            out.append(f"{name}{k + 1} AS (SELECT t, run AS i, CASE WHEN c = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")
        return out

    step = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: {step}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ways = [("l", k, "t", f"i // {16 ** k}") for k in range(levels)] + [("u", k, "''", f"g // {16 ** k}") for k in range(top)]
    joins = " ".join(f"JOIN {n}r{k} AS {n}j{k} ON {n}j{k}.t = {'d.t' if n == 'l' else t} AND {n}j{k}.run = ({at.replace('i ', 'd.i ').replace('g ', 'd.g ')}) // 16" for n, k, t, at in ways)
    sides, folds, last = [], [], "start"
    for x, (n, k, _, at) in enumerate(ways):
        place = f"(({at.replace('i ', 'd.i ').replace('g ', 'd.g ')}) % 16)"
        sides += [f"array_to_string(list_slice({n}j{k}.hs, 1, {place}), '') AS a{x}", f"array_to_string(list_slice({n}j{k}.hs, {place} + 2, 16), '') AS z{x}", f"{n}j{k}.c AS c{x}"]
        folds.append(f"f{x} AS (SELECT *, CASE WHEN c{x} = 1 THEN {last} ELSE sha256(a{x} || {last} || z{x}) END AS h{x} FROM {f'f{x - 1}' if x else 'ways'})")
        last = f"h{x}"
    proof = " || ".join(f"a{x} || z{x}" for x in range(len(ways)))
    return f"""
WITH base AS (SELECT doc_id, coalesce('s' || source, 'n') AS t, {leaf('text')} AS leaf, {leaf(lower)} AS other, coalesce({crc} % 5 = 0, false) AS tampered FROM documents),
d0 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base),
l0 AS (SELECT t, i, leaf AS h FROM d0), {", ".join(climb("l", "l0", levels))},
u0 AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, h, t AS source FROM l{levels}), {", ".join(climb("u", "u0", top))},
d AS (SELECT d0.*, u0.i AS g, u0.h AS subroot FROM d0 JOIN u0 ON u0.source = d0.t),
ways AS (SELECT d.*, CASE WHEN tampered THEN other ELSE leaf END AS start, {", ".join(sides)} FROM d {joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256({proof}) AS proof_sha256, {last} AS folded_root, {last} = r.h AS verified FROM f{len(ways) - 1}, (SELECT h FROM u{top}) r"""


def _crc32(rows: str, piece: int = 64) -> str:
    """CTEs up to `crc` (n, crc) over `rows` (n, t): registers of pieces, counted from a text's end, folded into one.

    A register is moved over a whole piece by one table a hex digit; the first piece, shorter than the others, carries the initial register.
    """

    def moved(c: int, digits: int) -> int:
        for _ in range(4 * digits):
            c = (c >> 1) ^ 3988292384 if c & 1 else c >> 1
        return c

    digit = f"{[moved(v, 1) for v in range(16)]}::BIGINT[]"
    whole = ", ".join(f"{[moved(v << 4 * k, 2 * piece) for v in range(16)]}::BIGINT[] AS w{k}" for k in range(8))
    shift = "0"
    for k in range(8):
        shift = f"xor({shift}, w{k}[((a >> {4 * k}) & 15) + 1])"
    return f"""
hexes AS (SELECT n, hex(encode(t)) AS h, strlen(t) AS size FROM {rows}),
pieces AS (SELECT n, 0 AS j, 4294967295 AS c, substr(h, 1, 2 * (size % {piece})) AS h FROM hexes
  UNION ALL SELECT n, j + 1, 0, substr(h, 2 * (size % {piece}) + {2 * piece} * j + 1, {2 * piece}) FROM (SELECT *, unnest(range(size // {piece})) AS j FROM hexes)),
registers AS (SELECT n, j, list_reduce(list_prepend(c::BIGINT, list_transform(range(len(h)), lambda i: ('0x' || h[i + 2 - 2 * (i % 2)])::BIGINT)),
  lambda a, b: xor(a >> 4, digit[xor(a & 15, b) + 1])) AS c FROM pieces, (SELECT {digit} AS digit)),
crc AS (SELECT n, xor(list_reduce(l, lambda a, b: xor({shift}, b)), 4294967295) AS crc
  FROM (SELECT n, list(c ORDER BY j) AS l FROM registers GROUP BY n), (SELECT {whole}))"""


def _shards(tree: Node) -> str:
    """Every node's draws written out: the lowest of -ln(u) / weight wins, level by level."""

    def reached(node: Node) -> str:
        if not node.children:
            return str(node.shard)
        draws = ", ".join(
            f"{{'d': -ln((('0x' || substr(md5(k || '/{c.name}'), 1, 13))::BIGINT + 0.5::DOUBLE) / pow(16::DOUBLE, 13)) / {c.weight}::DOUBLE, 'i': {i}}}"
            for i, c in enumerate(node.children, 1))
        return f"[{', '.join(map(reached, node.children))}][list_min([{draws}]).i]"

    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id::VARCHAR, '~') AS k, coalesce(text, '') AS t FROM documents),{_crc32("d")},
r AS (SELECT doc_id, k, (strlen(t) + 8)::BIGINT AS size, crc AS text_crc32, {reached(tree)} AS shard, {reached(grown(tree))} AS grown_shard FROM d JOIN crc USING (n))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', k, text_crc32)), doc_id, text_crc32) - 1 AS slot FROM r"""


SQL: dict[str, str] = {"op1_hash_tree_sharding": _shards(balanced_tree(3, 2, 4)), "op11_warc_archives": WARC, "op12_vector_codes": _codes(), "op13_merkle_manifest": _tree()}
