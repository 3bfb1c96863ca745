"""Every stage of the pipeline against a plain version of it, on what the stage before has kept."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

import corpus_pipeline as P
from grovespark.llm import mixing, packing, secrets, toxicity

from test_operators import plain_mask, plain_vector

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    """(rows in, rows out) of each stage by name, rows by doc_id; the last one's rows out as they are."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in P.STAGES:
        after = P.common.materialise(stage(spark, docs, DATA), name)
        out[name] = docs, after
        docs = after
    return out


def by_id(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def test_columns_stay(steps):
    first = steps["toxicity"][0].columns
    assert all(after.columns == first for name, (_, after) in steps.items() if name != "packing")


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    index = toxicity.fit_folds(spark, before, DATA)
    rows = by_id(before)
    examples = [plain_vector(index, rows[i]["text"]) for i in index.doc_ids.tolist()]
    want = set()
    for i, r in rows.items():
        query = plain_vector(index, r["text"])
        cosine = [(sum(w * query.get(f, 0) for f, w in v.items()), p) for p, v in enumerate(examples)]
        near = sorted(((s, p) for s, p in cosine if s > 0), key=lambda x: (-round(x[0], 12), x[1]))[: toxicity.NEIGHBOURS]
        share = sum(s * s * index.labels[p] for s, p in near) + toxicity.PRIOR_WEIGHT * index.prior
        score = np.interp(share / (sum(s * s for s, _ in near) + toxicity.PRIOR_WEIGHT), *index.curve)
        if score < toxicity.CUT:
            want.add(i)
    assert set(by_id(after)) == want and 0 < len(want)


def test_simhash(steps):
    before, after = steps["simhash"]
    rows, prints = by_id(before), {}
    for i, r in rows.items():
        words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"] or ""))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    least = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            low = min(least[b] for b in rows if (prints[a] ^ prints[b]).bit_count() <= 4)
            changed |= low != least[a]
            least[a] = low
    assert by_id(after) == {i: r for i, r in rows.items() if least[i] == i} and len(set(least.values())) < len(rows)


def test_secrets(steps):
    before, after = steps["secrets"]
    want, found = defaultdict(list), set()
    for r in secrets.scan(before).collect():
        found.add((r["doc_id"], r["place"], r["value"]))
        if r["is_secret"]:
            want[r["doc_id"]].append((r["place"], r["run"]))
    rows, kept, plain = by_id(before), by_id(after), set()
    for i, r in rows.items():
        for k, w in enumerate(re.split(r"[\x20\x09-\x0D]+", r["text"] or "")):
            plain |= {(i, k, v.rstrip(".") if not v.endswith("=") else v) for v in re.findall(f"[{secrets.KEY}]+={{0,2}}", w) if len(v.rstrip(".")) >= secrets.SHORTEST and re.search("[0-9]", v)}
        text = plain_mask(r["text"], want[i]) if want[i] else r["text"]
        assert kept[i]["text"] == text and kept[i]["n_chars"] == (len(text) if want[i] else r["n_chars"])
    assert {f for f in found if len(f[2]) >= secrets.SHORTEST and re.search("[0-9]", f[2])} == plain and set(kept) == set(rows) and any(want.values())


def poured(budget, capacity, weight):
    """What each sibling gets: what a full one can't take is dealt anew among the others."""
    got, left = {}, dict(capacity)
    while left:
        total = sum(weight[k] for k in left)
        full = [k for k, c in left.items() if c <= budget * weight[k] / total]
        if not full:
            return got | {k: budget * weight[k] / total for k in left}
        for k in full:
            got[k] = left.pop(k)
        budget -= sum(got[k] for k in full)
    return got


def test_mixing(steps):
    before, after = steps["mixing"]
    rows, leaf, tokens = by_id(before), {}, {}
    for i, r in rows.items():
        number = re.search(r"([0-9]{1,9})$", r["source"] or "")
        leaf[i] = (str(int(number[1]) % 4) if number else "none", r["lang"] or "none", r["source"] or "none")
        tokens[i] = len(WORD.findall(r["text"] or ""))
    budgets = {(): Fraction(int(sum(tokens.values()) * P.MIX_SHARE))}
    for depth, level in enumerate(mixing.LEVELS, 1):
        more = {}
        for parent, budget in budgets.items():
            capacity = defaultdict(int)
            for i, path in leaf.items():
                if path[: depth - 1] == parent:
                    capacity[path[:depth]] += tokens[i]
            more |= poured(budget, capacity, {k: Fraction(mixing.WEIGHTS[level].get(k[-1], 1.0)) for k in capacity})
        budgets = more
    want = set()
    for path, budget in budgets.items():
        at, limit = 0, int(budget + Fraction(1, 10**6))
        own = sorted((i for i in rows if leaf[i] == path), key=lambda i: hashlib.md5(f"{mixing.SEED}|0|{i}".encode()).hexdigest())
        whole = limit and limit == sum(tokens[i] for i in own)  # then texts without tokens, which end a leaf, come too
        for i in own:
            if at < limit or whole:
                want.add(i)
            at += tokens[i]
    assert by_id(after) == {i: rows[i] for i in want} and len(want) < len(rows)


def test_packing(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = steps["packing"]
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = set()
    for i, r in by_id(before).items():
        ids = np.array([*encode(r["text"] or "", add_special_tokens=False).ids, packing.END], "<u4")
        want |= {(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    rows = after.collect()
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096
    fewest = -(-sum(ends.values()) // 4096)
    assert len(ends) <= fewest + max(1, fewest // 100)
