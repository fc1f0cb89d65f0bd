"""Conversation repair against a plain search over all repairs."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from feedsift.llm import conversation
from feedsift.llm.common import table
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def _damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else text.translate(str.maketrans("", "", ".!?")) if d == 2 else text
        out += [(c, t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def _legal(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(body) > 0 and body == "ua" * (len(body) // 2))


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _best(rows, faults):
    """(cost, audit, lines) of the least repair, by a table over (rows read, roles written so far)."""
    def inserted(level):
        for _ in range(3):
            for said, (cost, audit, lines) in list(level.items()):
                new = "a" if said.endswith("u") else "u"
                key = (said + new)[-2:] if said not in ("", "s") else said + new
                way = (cost + 3, audit + "I", [*lines, ("assistant" if new == "a" else "user") + ":"])
                if key not in level or way[:2] < level[key][:2]:
                    level[key] = way
        return level

    def ok(said, new):
        return new == "s" and said == "" or new == "u" and not said.endswith("u") or new == "a" and said.endswith("u")

    level = {"": (0, "", [])}                              # said: the initials written, the last two of them at most
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}

        def put(said, way):
            if said not in after or way[:2] < after[said][:2]:
                after[said] = way

        for said, (cost, audit, lines) in inserted(level).items():
            put(said, (cost + 4, audit + "D", lines))
            if fault in ("", "truncated"):
                extra = 3 if fault else 0
                for name, edit, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if ok(said, name[:1]):
                        key = (said + name[:1])[-2:] if said not in ("", "s") else said + name[:1]
                        put(key, (cost + extra + price, audit + edit, [*lines, f"{name}:{text}"]))
        level = after
    return min((way for said, way in inserted(level).items() if said == "" or said.endswith("a")), key=lambda w: w[:2])


def _expected(rows):
    """The contract's row for one conversation's rows, already damaged and in order."""
    faults = _faults(rows)
    cost, audit, lines = _best(rows, faults)
    turns = [r[1] for r in rows if r[1] is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def _check(got, rows, damage):
    left = {}
    for r in _damage(rows) if damage else [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]:
        left.setdefault(r[0], []).append(r)
    found = {r.conv_id: r.asDict() for r in got.collect()}
    assert set(found) == ({r[0] for r in rows} if damage else set(left))
    for c, row in found.items():
        row.pop("conv_id")
        want = _expected(_ordered(left[c])) if c in left else dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
        assert row == want, c


def _random(seed, conversations, longest):
    rnd = random.Random(seed)
    texts = ["One.", "Two?", "cut", "", " \t", "Same!", "new %d.", "open %d"]
    rows = []
    for c in range(conversations):
        turns = [rnd.choice([*range(2 * longest), None]) for _ in range(rnd.randrange(1, longest))]
        for i, t in enumerate(turns):
            text = rnd.choice(texts)
            rows.append((c if c else None, t, rnd.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""]), text % i if "%" in text else rnd.choice([text, None])))
    return rows


def test_damage_and_repair_match_a_plain_search(spark):
    rows = _random(1, 300, 9) + [(1000, t, "user", "x") for t in range(400)]
    _check(conversation.repair_damaged(spark.createDataFrame(rows, SCHEMA)), rows, True)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_segments_of_any_size_give_the_same_repairs(spark, bits):
    rows = _random(2, 25, 12) + [(77, t, "assistant" if t % 3 else "user", f"turn {t}" + "." * (t % 2)) for t in range(60)]
    _check(conversation.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), segment_bits=bits), rows, False)


def test_one_conversation_with_most_rows_is_spread_over_segments(spark):
    rows = [(5, t, ("user", "assistant", "assistant")[t % 3], f"n{t}.") for t in range(3000)] + _random(3, 40, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = [r["count"] for r in conversation._coded(conversation._rows(df, None), 8).groupBy("seg").count().collect()]
    assert max(sizes) <= 256 and len(sizes) >= 12
    _check(conversation.repair(df, segment_bits=8), rows, False)


def test_query_on_the_given_table(spark):
    t = table(spark, SMALL, "conversations")
    rows = [tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()]
    _check(conversation.repair_damaged(t), rows, True)


def test_repaired_rows_are_legal_and_end_in_the_digest(spark):
    rows = _random(4, 60, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    lines = {}
    for r in conversation.repaired_rows(df).collect():
        lines.setdefault(r.conv_id, []).append((r.position, r.edit, f"{r.role}:{r.text}"))
    for r in conversation.repair(df).collect():
        mine = sorted(lines.get(r.conv_id, []))
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert "".join(e for _, e, _ in mine) == r.audit.replace("D", "")
        assert _legal("".join(x[:1] for _, _, x in mine))
        assert hashlib.sha256("\n".join(x for _, _, x in mine).encode()).hexdigest() == r.repaired_sha256


def test_empty_tables_clashing_columns_and_long_texts(spark):
    assert conversation.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "ok."), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", "y", 3, "z") for r in rows], SCHEMA + ", again string, seg string, row_id int, digest string")
    _check(conversation.repair(df), rows, False)
    _check(conversation.repair_damaged(df), rows, True)


def test_rank_paths_orders_audits():
    rnd = np.random.default_rng(0)
    letter = np.append(rnd.integers(0, 4, 200), -1).astype(np.int8)
    to = np.append([rnd.integers(i + 1, 201) for i in range(200)], 200)
    rank, hops, n = conversation.rank_paths(letter, to)

    def audit(v):
        out = ""
        while letter[v] >= 0:
            out, v = out + conversation.LETTERS[letter[v]], to[v]
        return out

    words = [audit(v) for v in range(201)]
    order = {w: i for i, w in enumerate(sorted(set(words)))}
    assert [order[w] for w in words] == rank.tolist() and [len(w) for w in words] == n.tolist()
    spelled, ends = conversation.spell(np.arange(201), letter, (rank, hops, n))
    assert spelled.to_pylist() == words and (ends == 200).all()
