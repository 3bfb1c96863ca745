"""Harmonic packing, vector codes and conversation repair against brute force, on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from grovespark.llm import codes, harmonic, repair

DATA = "/root/testdata/sf0.001"


def against_sql(spark, name, query, sql):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got, want = query(spark, DATA).toPandas(), con.execute(sql).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = lambda f: sorted(map(repr, f[names].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want), name


@pytest.mark.parametrize("module", [codes, repair])
def test_equal_to_sql(spark, module):
    for name, sql in module.SQL.items():
        against_sql(spark, name, module.QUERIES[name], sql)


# harmonic packing


def padding(rows, sequence=4096):
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    return sum(sequence - n for n in fill.values() if n & (n - 1)), sum(fill.values())


def check_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want, got = Counter(), defaultdict(list)
    for i, text in docs:
        want[i, np.array([*encode(text or "", add_special_tokens=False).ids, harmonic.END], "<u4").tobytes()] += 1
    ids = defaultdict(list)
    for (i, data), n in want.items():
        ids[i].append((data, n))
    for r in rows:
        got[r["doc_id"], r["doc_tokens"]].append(r)
    assert sum(r["length"] for r in rows) == sum(len(d) // 4 * n for (_, d), n in want.items())
    for i, all_ids in ids.items():
        for tokens in {len(d) // 4 for d, _ in all_ids}:
            pieces, left = sorted(got[i, tokens], key=lambda r: r["start"]), Counter()
            for d, n in all_ids:
                if len(d) // 4 == tokens:
                    left[d] += n
            cover = Counter(p for r in pieces for p in range(r["start"], r["start"] + r["length"]))
            assert set(cover.values()) == {sum(left.values())} and len(cover) == tokens
            for r in pieces:
                assert any(zlib.crc32(d[r["start"] * 4 : (r["start"] + r["length"]) * 4]) == r["ids_crc32"] for d in left)
    ends, number = Counter(), Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
        number[r["sequence_id"], r["class"]] += 1
    assert max(ends.values()) <= 4096
    assert all(n == of for (_, of), n in number.items() if of) and len(number) == len(ends)
    assert all(n & (n - 1) == 0 for s, n in ends.items() if (s, 0) in number)


def test_harmonic_packing_of_odd_rows(spark):
    pick = random.Random(5)
    texts = [" ".join(pick.choice(["tree", "Wald", "naïve", "x1.5,", "(ok)", "<|endoftext|>"]) for _ in range(pick.randint(1, 900))) for _ in range(60)]
    texts += [None, "", " \n\t ", texts[0], texts[0], "word " * 30_000, "a" * 5_000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, "lone leaf", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string, length int").repartition(3)
    out = harmonic.pack_documents(docs).collect()
    check_packing([r[:2] for r in rows], out)
    small = harmonic.pack_documents(docs, chunk=2_000).collect()  # open sequences go on from chunk to chunk
    check_packing([r[:2] for r in rows], small)
    assert harmonic.pack_documents(docs.limit(0)).count() == 0


def test_harmonic_query(spark):
    rows = harmonic.op11_harmonic_packing(spark, DATA).collect()
    check_packing([tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()], rows)
    padded, used = padding(rows)
    assert padded < 0.005 * used


def test_cuts_are_shares_of_a_sequence():
    sizes = np.arange(1, 3 * 4096 + 2)
    doc, start, length = harmonic.cut(sizes)
    assert (np.bincount(doc, length) == sizes).all()
    of = 4096 // length
    last = np.r_[doc[1:] != doc[:-1], True]
    assert (4096 // of - length <= harmonic.SLACK).all()
    assert (length[~last] == 4096 // of[~last]).all()
    assert (start[1:] == np.where(last[:-1], 0, start[:-1] + length[:-1])).all() and start[0] == 0


# vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i, tuple(int(np.floor(256 * float(x))) for x in v), label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, p: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(part(v, p), p)[1]].append(part(v, p))
            new.append([tuple(sum(c) // len(own[e]) for c in zip(*own[e])) if own[e] else old for e, old in enumerate(books[p])])
        books = new
    coded = [(i, [near(part(v, p), p) for p in range(parts)], label) for i, v, label in kept]
    total = Counter()
    for _, best, label in coded:
        total[label] += sum(d for d, _ in best)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), total[label], sha) for i, best, label in coded)


@pytest.mark.parametrize(("number", "scale"), [(150, 1.0), (20, 1.0), (90, 3000.0)])
def test_vector_codes(spark, number, scale):
    pick = random.Random(number)
    vector = lambda: [float(np.float32(pick.gauss(0, scale))) for _ in range(32)]
    good = [(i * 7, vector(), pick.choice([1, 2, None])) for i in range(number)]
    good += [good[0], (good[1][0], vector(), 5), (None, vector(), 2), (10**6, good[2][1], 1)]
    bad = [(-1, None, 1), (-2, [*vector()[:-1], None], 1), (-3, [*vector()[:-1], float("nan")], 1), (-4, [*vector()[:-1], float("-inf")], 1), (-5, [], 1), (-6, [0.5] * 16, 1), (-7, [0.5] * 30, 1)]
    df = spark.createDataFrame([(*r, "x") for r in good + bad], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    assert Counter(map(tuple, codes.compress(df).collect())) == plain_codes(good)
    assert codes.compress(df.where("vec_id in (-1, -2, -5, -7)")).count() == 0 and codes.compress(df.limit(0)).count() == 0
    assert codes.compress(df.limit(0)).columns == codes.compress(df).columns


def test_limb_products_are_exact():
    draw = np.random.default_rng(1)
    for bits, width in ((6, 4), (20, 4), (27, 4), (27, 48)):
        x, c = (draw.integers(-(1 << bits), (1 << bits) + 1, (50, width)) for _ in range(2))
        x[0], c[0] = 1 << bits, -(1 << bits)
        want = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in c] for r in x]
        assert codes.dots(x, c).tolist() == want


def test_saturation_fits_a_long():
    for dims in (1, 16, 64, 100, 4096):
        most = codes.saturation(dims)
        assert dims * (2 * most) ** 2 < 1 << 63
    df = codes.integers(__import__("pyarrow").array([[1e30, -1e30]]), 2, 1)
    assert df.ravel().tolist() == [codes.saturation(2), -codes.saturation(2)]


# conversation repair


def plain_way(codes_):
    """The least (cost, audit) by going from row to row with all states; inserts up to three in a row."""
    states = {0: (0, "")}

    def inserted(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                to, new = (3 if s == 2 else 2), (c + 3, a + "I")
                states[to] = min(states.get(to, new), new)
        return states

    states = inserted(states)
    for code in codes_:
        new = {}
        add = lambda s, way: new.__setitem__(s, min(new.get(s, way), way))
        for s, (c, a) in states.items():
            add(s, (c + 4, a + "D"))
            if code in "suaxSUAX":
                more = 3 if code.isupper() else 0
                add(3 if s == 2 else 2, (c + 3 + more, a + "R"))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, code.lower()))
                if to:
                    add(to, (c + more, a + "K"))
        states = inserted(new)
    return min(states[s] for s in (0, 3) if s in states)


def all_ways(codes_):
    """The least (cost, audit) of all edit strings with up to three inserts, judged by the grammar as a pattern."""
    best = None
    for n_inserts in range(4):
        for places in itertools.combinations_with_replacement(range(len(codes_) + 1), n_inserts):
            for edits in itertools.product("KRD", repeat=len(codes_)):
                audit = "".join("I" * places.count(i) + e for i, e in enumerate(edits)) + "I" * places.count(len(codes_))
                cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + sum(3 for e, c in zip(edits, codes_) if c.isupper() and e != "D")
                if best is not None and (cost, audit) >= best or any(c.isdigit() and e != "D" for e, c in zip(edits, codes_)):
                    continue
                at, choices = 0, []
                for e in audit:
                    choices.append("ua" if e in "RI" else codes_[at].lower() if e == "K" else ("",))
                    at += e != "I"
                if any(re.fullmatch("(s?(ua)+)?", "".join(c)) for c in itertools.product(*choices)):
                    best = (cost, audit)
    return best


def test_bidirectional_search_is_exact():
    pick = random.Random(2)
    for _ in range(60):
        row = "".join(pick.choice("suaxSUAX05") for _ in range(pick.randint(0, 4)))
        assert repair.cheapest(row, 0, repair.ACCEPT) == plain_way(row) == all_ways(row), row
    for _ in range(300):
        row = "".join(pick.choice("ssuuuaaaxSUA05") for _ in range(pick.randint(5, 60)))
        assert repair.cheapest(row, 0, repair.ACCEPT) == plain_way(row), row


def plain_repair(rows):
    text_of = lambda v: " " if v is None else str(v)
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        own, (role, text) = by_conv[conv], (text_of(role), text_of(text))
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            own += [row] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, letters, counts = set(), "", Counter()
        for _, role, text in own:
            fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else ""
            seen.add((role, text))
            counts[fault] += 1
            letters += repair.FAULTS[fault]["sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3]
        turns = {t for t, _, _ in own if t is not None}
        who = [r[1][:1] for r in own]
        cost, audit = plain_way(letters)
        state, kept, rest = "", [], iter(own)
        for e in audit:
            row = None if e == "I" else next(rest)
            if e == "D":
                continue
            role = row[1] if e == "K" else "assistant" if state == "u" else "user"
            kept.append(f"{role}:{row[2] if row else ''}")
            state = role[0]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks(spark):
    pick = random.Random(9)
    rows = []
    for conv in [*range(40), None, 77]:
        for turn in range(700 if conv == 77 else pick.randint(1, 14)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]) if pick.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = pick.choice([f"Say {turn}.", f"Say {turn}", "same. ", "", " \t", None, "é! \n", f"{turn} ends?!"])
            rows.append((conv, None if pick.random() < 0.05 else turn + 3 * (pick.random() < 0.05), role, text))
    rows += [rows[5], rows[6], (900, 1, "user", "Long. " * 20_000)]
    rows += [(c, 0, "user", "Gone.") for c in range(1000, 1200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, copy int").repartition(4)


@pytest.mark.parametrize("block", [3, 128])
def test_conversation_repair(talks, block):
    rows, df = talks
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df, block).collect()}
    want = plain_repair(rows)
    for conv in {r[0] for r in rows}:
        assert got[conv] == want.get(conv, (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())), conv
    assert len(got) == len({r[0] for r in rows}) and any(v[6] == "" for v in got.values())
    assert repair.repair(df.limit(0)).count() == 0
