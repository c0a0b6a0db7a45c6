"""DuckDB expressions that oracles share: hashes over bytes, and folds of events in order as recursions."""

from __future__ import annotations

from collections.abc import Callable

M = 1 << 32


def let(value: str, body: Callable[[str], str], name: str) -> str:
    """``body`` of a value that is computed once."""
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def low(x: str) -> str:
    """The low 32 bits."""
    return f"(({x}) & {M - 1})"


def times(a: str, b: int) -> str:
    return f"CAST(CAST({a} AS HUGEINT) * {b} % {M} AS BIGINT)"


def rotated(x: str, r: int) -> str:
    return low(f"({x} << {r}) | ({x} >> {32 - r})")


def code_bytes(text: str) -> str:
    """Bytes of an ASCII text."""
    return f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"


def crc(text: str, poly: int) -> str:
    """Reflected 32-bit CRC, all ones before and after."""
    step = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, {poly} * (x & 1)))"
    return f"xor(list_reduce(list_prepend(CAST({M - 1} AS BIGINT), {code_bytes(text)}), lambda c, b: {step}), {M - 1})"


def murmur(text: str) -> str:
    """The 32-bit x86 form with seed 0, of an ASCII text."""

    def mixed(k: str, n: str) -> str:
        return let(let(times(k, 0xCC9E2D51), lambda a: rotated(a, 15), f"m{n}"), lambda b: times(b, 0x1B873593), f"r{n}")

    def whole(bs: str) -> str:
        word = f"({bs}[4 * i + 1] | ({bs}[4 * i + 2] << 8) | ({bs}[4 * i + 3] << 16) | ({bs}[4 * i + 4] << 24))"
        words = f"list_transform(range(len({bs}) // 4), lambda i: {mixed(word, '1')})"
        h = f"list_reduce(list_prepend(CAST(0 AS BIGINT), {words}), lambda h, k: {let('xor(h, k)', lambda x: low(f'{rotated(x, 13)} * 5 + {0xE6546B64}'), 'y')})"
        rest = f"list_sum(list_transform(range(len({bs}) % 4), lambda j: {bs}[len({bs}) // 4 * 4 + j + 1] << CAST(8 * j AS INTEGER)))"
        tail = mixed(f"CAST(coalesce({rest}, 0) AS BIGINT)", "2")
        x = f"xor(xor({h}, {tail}), len({bs}))"
        for i, (shift, factor) in enumerate(((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None))):
            x = let(x, lambda v, s=shift, f=factor: times(f"xor({v}, {v} >> {s})", f) if f else f"xor({v}, {v} >> {s})", f"f{i}")
        return x

    return let(code_bytes(text), whole, "bs")


def super_fast(text: str) -> str:
    """The hash of 16-bit pieces, of an ASCII text."""

    def whole(bs: str) -> str:
        two = lambda at: f"({bs}[{at} + 1] | ({bs}[{at} + 2] << 8))"
        n = f"len({bs})"

        def block(h: str, i: str) -> str:
            grown = low(f"{h} + {two(f'4 * {i}')}")
            mixed = let(grown, lambda g: f"xor({low(f'{g} << 16')}, xor({two(f'4 * {i} + 2')} << 11, {g}))", "g")
            return let(mixed, lambda x: low(f"{x} + ({x} >> 11)"), "x")

        h = f"list_reduce(list_prepend(CAST({n} AS BIGINT), range({n} // 4)), lambda h, i: {block('h', 'i')})"
        at = f"{n} // 4 * 4"

        def end(h: str) -> str:
            def grow(add: str, shift: int, back: int, also: str = "") -> str:
                first = let(low(f"{h} + {add}"), lambda a: f"xor({a}, {low(f'{a} << {shift}')})", f"a{shift}")
                if also:
                    first = f"xor({first}, {also})"
                return let(first, lambda b: low(f"{b} + ({b} >> {back})"), f"b{shift}")

            return f"CASE {n} % 4 WHEN 3 THEN {grow(two(at), 16, 11, f'({bs}[{at} + 3] << 18)')} WHEN 2 THEN {grow(two(at), 11, 17)} WHEN 1 THEN {grow(f'{bs}[{at} + 1]', 10, 1)} ELSE {h} END"

        x = let(h, end, "e")
        for i, (left, right) in enumerate(((3, 5), (4, 17), (25, 6))):
            x = let(let(x, lambda v, s=left: f"xor({v}, {low(f'{v} << {s}')})", f"p{i}"), lambda v, s=right: low(f"{v} + ({v} >> {s})"), f"q{i}")
        return x

    return let(code_bytes(text), whole, "bs")


def in_order(events: str, key: str, order: str, start: dict[str, str], lets: dict[str, str], step: dict[str, str], out: str) -> str:
    """A fold of each key's events in order: ``start`` and ``step`` give the state's columns, ``lets`` names steps between (each sees those before)."""
    state = ", ".join(start)
    first = ", ".join(f"{v} AS {k}" for k, v in start.items())
    inner = "SELECT r.*, " + ", ".join(f"f.{k}" for k in start) + " FROM f JOIN o r ON r._key = f._key AND r._rn = f._rn + 1"
    for k, v in lets.items():
        inner = f"SELECT *, {v} AS {k} FROM ({inner})"
    return (
        f"WITH RECURSIVE o AS (SELECT *, {key} AS _key, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _rn FROM {events}), "
        f"f AS (SELECT _key, CAST(0 AS BIGINT) AS _rn, {first}, CAST(NULL AS BIGINT) AS _at FROM (SELECT DISTINCT _key FROM o) "
        f"UNION ALL SELECT _key, _rn, {', '.join(f'{v} AS {k}' for k, v in step.items())}, {order} AS _at FROM ({inner})) "
        f"SELECT {out} FROM f WHERE _rn > 0"
    ).replace("{state}", state)


def breaker_window(name: str, window: int, percent: int) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """start, lets and step of one window of a circuit breaker over events with ``error`` and ``latency``."""
    n, e, c, lat = (f"{name}_{x}" for x in "necl")
    smooth = f"pow(0.02, 1.0 / {window})"
    lets = {
        f"{name}_l2": f"CASE WHEN error THEN {lat} WHEN {lat} = 0 THEN latency ELSE CAST(trunc({lat} * {smooth} + latency * (1 - {smooth})) AS BIGINT) END",
        f"{name}_k": f"CASE WHEN NOT error THEN 0 WHEN {lat} <> 0 THEN least({lat} * 2, latency) ELSE latency END",
        f"{name}_c2": f"CASE WHEN {name}_k <> 0 THEN {c} + {name}_k WHEN {c} >= 500 THEN CAST(trunc({c} * {smooth}) AS BIGINT) ELSE 0 END",
        f"{name}_g": f"CASE WHEN {n} < {window} THEN NOT error OR {e} < {window * percent // 100} ELSE {name}_k = 0 OR {name}_c2 <= trunc({lat} * {window} * CAST({percent / 100.0} AS DOUBLE) * CAST(1.02 AS DOUBLE)) END",
    }
    start = {x: "CAST(0 AS BIGINT)" for x in (n, e, c, lat)}
    step = {n: f"least({n} + 1, {window})", e: f"{e} + CASE WHEN error AND {n} < {window} THEN 1 ELSE 0 END", c: f"{name}_c2", lat: f"{name}_l2"}
    return start, lets, step
