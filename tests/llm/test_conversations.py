"""Conversation repair against a search over all edits, with blocks of several sizes and awkward rows."""

import hashlib
import random
import re
import zlib

import pytest

from paymatch.llm import conversations, queries

SF = "/root/testdata/sf0.01"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "ux", "s"]


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(turns):
    """Cost, least audit and lines over all edits, state by state from the front."""
    seen, faults = set(), []
    for role, text in turns:
        visible = VISIBLE.findall(text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen
                      else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))

    def offer(states, state, way):
        if state not in states or way[:2] < states[state][:2]:
            states[state] = way

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, lines) in list(states.items()):
                offer(states, NEXT[s], (cost + 3, audit + "I", (*lines, ROLE[NEXT[s]] + ":")))

    states = {0: (0, "", ())}
    for (role, text), fault in zip(turns, faults):
        inserted(states)
        after = {}
        for s, (cost, audit, lines) in states.items():
            offer(after, s, (cost + 4, audit + "D", lines))
            if fault in ("", "truncated"):
                more = cost + 3 * (fault == "truncated")
                offer(after, NEXT[s], (more + 3, audit + "R", (*lines, f"{ROLE[NEXT[s]]}:{text}")))
                if (s, role[:1]) in KEEP:
                    offer(after, KEEP[s, role[:1]], (more, audit + "K", (*lines, f"{role}:{text}")))
        states = after
    inserted(states)
    return faults, min((states[s] for s in (0, 3) if s in states), key=lambda w: w[:2])


def brute(rows):
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows):
        convs[conv].append((turn, role, text))
    out = {}
    for conv, turns in convs.items():
        name = "-" if conv is None else str(conv)
        key = f"{str(conv is None).lower()}:{len(name)}"
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(
            f"{key}:{len(t[1].encode())}:{name}{t[1]}{t[2]}".encode()).digest()))
        faults, (cost, audit, lines) = cheapest([t[1:] for t in turns])
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def query(spark, folder):
    return {r.conv_id: tuple(r)[1:] for r in queries.queries()["op12_conversations"](spark, folder).collect()}


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert query(spark, SF) == brute([tuple(r) for r in rows])


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = ["hi.", "hi", "", None, " \n", "ok! ", "é?", "x" * 50_000 + "."]
    rows = [(c, rng.choice([t, t, t, None]), rng.choice(ROLES), rng.choice([*texts, f"Yes. {t}", f"q{t}?"]))
            for c in range(100) for t in range(rng.choice([1, 2, 5, 9]))]
    # one conversation over several blocks, and the rows of a null id
    rows += [(777, t, rng.choice(ROLES), rng.choice(["a.", "b", f"c.{t}", f"q{t}?", ""])) for t in range(2000)]
    rows += [(None, t, rng.choice(ROLES), f"x.{t % 7}") for t in range(40)]
    rows += [(5000, 0, "user", "same.")] * 3
    folder = str(tmp_path_factory.mktemp("conversations"))
    schema = "conv_id long, turn long, role string, text string, place string, block int, edit string"
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema).repartition(3).write.parquet(
        f"{folder}/conversations.parquet")
    return folder, rows


def test_awkward_rows(spark, awkward):
    folder, rows = awkward
    assert query(spark, folder) == brute(rows)


def test_turns_read_as_conversations(spark, awkward):
    rows = spark.read.parquet(f"{awkward[0]}/conversations.parquet")
    fixed = conversations.repair(rows)
    by = {}
    for r in fixed.turns.orderBy("place", "step").collect():
        assert r.edit in "IKR" and (r.edit != "I" or r.text == "")
        by.setdefault(r.conv_id, []).append(r.role[0])
    assert by and all(re.fullmatch("s?(ua)+", "".join(v)) for v in by.values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert query(spark, str(tmp_path)) == {}


@pytest.mark.parametrize("n", [1, 7, 100])
def test_checkpoints_change_nothing(n):
    """Blocks put together by their matrices and exits are one long walk."""
    rng = random.Random(n)
    codes = "".join(chr(65 + rng.randrange(16)) for _ in range(n))
    whole, states = conversations._walks(codes, conversations.END, True)
    cut = rng.randrange(n)
    vector = conversations.END
    m = conversations._matrix(codes[cut:])
    between = tuple(min(m[4 * s + t] + vector[t] for t in range(4)) for s in range(4))
    first, exits = conversations._walks(codes[:cut], between, False)
    second, _ = conversations._walks(codes[cut:], conversations.END, True)
    for s in range(4):
        assert whole[s] == (f"{first[s]}," if cut else "") + second[exits[s]]
