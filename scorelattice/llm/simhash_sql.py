"""SimHash groups in SQL: XXH64 worked out lane by lane, fingerprints by counting bits, links between all pairs."""

from __future__ import annotations

# Fixed values of the hash: its five primes; and the seed of the fingerprints.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SEED, _TOP = 42, 1 << 64


def _mod(sql: str) -> str:
    return f"CAST(({sql}) % CAST({_TOP} AS UHUGEINT) AS UBIGINT)"


def _mul(a: str, b: int) -> str:
    return _mod(f"CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)")


def _add(a: str, b: str) -> str:
    return _mod(f"CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)")


def _rotl(column: str, by: int) -> str:
    return f"({_mul(column, 1 << by)} | ({column} >> {64 - by}))"


def _little(hex_: str, at: str, size: int) -> str:
    """The number that `size` bytes from a byte on spell, the first byte lowest."""
    parts = " || ".join(f"substr({hex_}, CAST(2 * ({at} + {k}) AS BIGINT) + 1, 2)" for k in reversed(range(size)))
    return f"CAST('0x' || {parts} AS UBIGINT)"


def _steps(source: str, *columns: dict[str, str]) -> str:
    """Nested selects, each of which may name the columns of those within."""
    out = source
    for own in columns:
        out = f"(SELECT * REPLACE ({', '.join(f'{sql} AS {c}' for c, sql in own.items())}) FROM {out})"
    return out


_LANES = "abcd"
_stripe = _steps(
    "(SELECT * FROM stripes WHERE 32 * (done + 1) <= n)",
    {v: _add(v, _mul(_little("hx", f"32 * done + {8 * k}", 8), _P2)) for k, v in enumerate(_LANES)},
    {v: _rotl(v, 31) for v in _LANES},
    {v: _mul(v, _P1) for v in _LANES},
)
_merge = [step for v in _LANES for step in ({v: _mul(v, _P2)}, {v: _rotl(v, 31)}, {v: _mul(v, _P1)}, {"h": f"xor(h, {v})"}, {"h": _add(_mul("h", _P1), str(_P4))})]
_merged = _steps(f"(SELECT *, {_add(_add(_rotl('a', 1), _rotl('b', 7)), _add(_rotl('c', 12), _rotl('d', 18)))} AS h FROM stripes WHERE 32 * (done + 1) > n AND n >= 32)", *_merge)


def _tail(size: int, rounds: list[dict[str, str]]) -> str:
    return _steps(f"(SELECT *, {_little('hx', 'pos', size)} AS k FROM tails WHERE n - pos >= {size}" + (" AND n - pos < 8" if size == 4 else " AND n - pos < 4" if size == 1 else "") + ")", *rounds)


_eight = _tail(8, [{"k": _mul("k", _P2)}, {"k": _rotl("k", 31)}, {"k": _mul("k", _P1)}, {"h": "xor(h, k)"}, {"h": _rotl("h", 27)}, {"h": _add(_mul("h", _P1), str(_P4))}])
_four = _tail(4, [{"k": _mul("k", _P1)}, {"h": "xor(h, k)"}, {"h": _rotl("h", 23)}, {"h": _add(_mul("h", _P2), str(_P3))}])
_one = _tail(1, [{"k": _mul("k", _P5)}, {"h": "xor(h, k)"}, {"h": _rotl("h", 11)}, {"h": _mul("h", _P1)}])
_final = _steps("(SELECT s, h FROM tails WHERE pos = n)", {"h": "xor(h, h >> 33)"}, {"h": _mul("h", _P2)}, {"h": "xor(h, h >> 29)"}, {"h": _mul("h", _P3)}, {"h": "xor(h, h >> 32)"})

OP8_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM words, unnest(range(1, greatest(2, len(ws) - 2))) AS r(i) WHERE len(ws) > 0),
texts AS (SELECT DISTINCT s, hex(s) AS hx, CAST(strlen(s) AS BIGINT) AS n FROM shingles),
stripes AS (SELECT *, CAST(0 AS BIGINT) AS done, CAST({(_SEED + _P1 + _P2) % _TOP} AS UBIGINT) AS a, CAST({(_SEED + _P2) % _TOP} AS UBIGINT) AS b, CAST({_SEED} AS UBIGINT) AS c, CAST({(_SEED - _P1) % _TOP} AS UBIGINT) AS d FROM texts WHERE n >= 32
  UNION ALL SELECT * REPLACE (done + 1 AS done) FROM {_stripe}),
begun AS (SELECT s, hx, n, 32 * done AS pos, h FROM {_merged} UNION ALL SELECT s, hx, n, 0, CAST({_SEED + _P5} AS UBIGINT) FROM texts WHERE n < 32),
tails AS (SELECT s, hx, n, pos, {_add("h", "n")} AS h FROM begun
  UNION ALL (SELECT s, hx, n, pos + 8, h FROM {_eight} UNION ALL SELECT s, hx, n, pos + 4, h FROM {_four} UNION ALL SELECT s, hx, n, pos + 1, h FROM {_one})),
hashes AS (SELECT s, h FROM {_final}),
bits AS (SELECT doc_id, b, 2 * sum((h >> CAST(b AS UBIGINT)) & 1) > count(*) AS is_set FROM shingles JOIN hashes USING (s), unnest(range(0, 64)) AS r(b) GROUP BY doc_id, b),
prints AS (SELECT w.doc_id, coalesce(CAST(sum(CASE WHEN is_set THEN CAST(1 AS UBIGINT) << CAST(b AS UBIGINT) ELSE CAST(0 AS UBIGINT) END) AS UBIGINT), CAST(0 AS UBIGINT)) AS fp FROM words w LEFT JOIN bits USING (doc_id) GROUP BY w.doc_id),
classes AS (SELECT fp, min(doc_id) AS id FROM prints GROUP BY fp),
links AS (SELECT x.id AS x, y.id AS y FROM classes x JOIN classes y ON bit_count(xor(x.fp, y.fp)) <= 4 WHERE x.id <> y.id),
reach AS (SELECT id AS x, id AS y FROM classes UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
roots AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN classes USING (fp) JOIN roots USING (id)
"""
