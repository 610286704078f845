"""Sharding, packing, decontamination, quality rules and secrets against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import by_row

from canvass.llm import decontaminate, packing, quality_rules, secrets, sharding
from canvass.llm.queries import tokenizer_path


def cases(odd, small):
    return [odd, small]


# --- sharding
def jump_plain(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("which", ["odd", "small", "clashing", "none"])
def test_sharding(which, request):
    docs = request.getfixturevalue(which)
    got = [r.asDict() for r in sharding.shard(docs, 8).collect()]
    want = []
    for r in docs.select("doc_id", "text").collect():
        raw, key = (r[1] or "").encode(), r[0] or 0
        want.append((r[0], len(raw) + 1, zlib.crc32(raw), jump_plain(key, 8), jump_plain(key, 9)))
    assert sorted(map(repr, want)) == sorted(
        repr((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"])) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- packing
@pytest.mark.parametrize("which", ["odd", "small", "clashing", "none"])
def test_packing(which, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    whole = Tokenizer.from_file(tokenizer_path())
    packed = packing.pack_documents(docs, tokenizer_path())
    got = [r.asDict() for r in packed.collect()]
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[(r[0], len(ids), b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    texts = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        texts.setdefault((r["doc_id"], r["doc_tokens"]), {}).setdefault(r["start"], []).append(bytes(r["ids"]))
    # repeated rows give the same pieces as often as there are rows
    for (doc, n, blob), times in want.items():
        assert all(len(p) == times for p in texts[(doc, n)].values())
        assert b"".join(p[0] for _, p in sorted(texts[(doc, n)].items())) == blob
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    joined = {r[0]: (bytes(r[1]), r[2]) for r in packing.sequences(packed).collect()}
    for s, parts in filled.items():
        assert joined[s][1] == sum(n for _, n in parts) == len(joined[s][0]) // 4


def test_packing_wastes_little(small):
    got = packing.pack_documents(small, tokenizer_path(), keep_ids=False).collect()
    used, packs = sum(r["length"] for r in got), len({r["sequence_id"] for r in got})
    assert packs <= used / 2048 * 1.03 + 2


def test_plan_is_bounded_by_the_capacity():
    few = packing.plan_packs({n: 3 for n in range(1, 2049)})
    many = packing.plan_packs({n: 3_000_000 for n in range(1, 2049)})
    assert len(packing.slots_of(many)) <= 2 * len(packing.slots_of(few))


# --- decontamination
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def overlaps_plain(docs, items):
    windows = {}
    for name, text in items:
        ws = plain_words(text)
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            windows.setdefault(n, {}).setdefault(tuple(ws[i:i + n]), set()).add(str(name))
    out = []
    for doc, text in docs:
        ws, hit, found = plain_words(text), set(), set()
        for n, table in windows.items():
            for i in range(len(ws) - n + 1):
                if names := table.get(tuple(ws[i:i + n])):
                    found |= names
                    hit |= set(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(found), digest))
    return sorted(map(repr, out))


def overlap_rows(frame):
    return sorted(repr(tuple(r)) for r in frame.selectExpr(
        "doc_id", "n_words", "aggregate(hit_spans, cast(0 as bigint), (a, x) -> x - a) as n_hit",
        "cast(size(items) as bigint) as n_items", "sha2(array_join(array_sort(items), ','), 256) as d").collect())


ITEMS = [(1, "Alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima"), (2, "lime"), (3, None), (4, ""),
         (5, "grape, melon; PEACH"), (6, "lemon lime"), (70, "x x x x x x x x x x x x"), (8, "no id"),
         (9, "One one one one one one one one one one one")]


@pytest.mark.parametrize("which", ["odd", "clashing", "none"])
@pytest.mark.parametrize("block", [32_000_000, 1])
def test_decontamination(spark, which, block, request):
    docs = request.getfixturevalue(which)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    frame, restored = decontaminate.matches(docs, items, block_bytes=block)
    got = overlap_rows(frame.withColumnRenamed("_0", "doc_id") if which != "clashing" else frame.withColumnRenamed("_0", "doc_id"))
    assert got == overlaps_plain([tuple(r) for r in docs.select("doc_id", "text").collect()], ITEMS)
    assert restored(frame).columns == docs.columns


def test_decontamination_of_the_table(spark, small, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert overlap_rows(decontaminate.overlaps(small, bench)) == overlaps_plain(rows, [tuple(r) for r in bench.collect()])
    empty = decontaminate.overlaps(small, bench.where("false"))
    assert empty.where("size(items) > 0 or longest > 0").count() == 0 and empty.count() == len(rows)
    kept = decontaminate.decontaminate(small, bench)
    assert kept.columns == small.columns
    assert kept.count() == sum(",0, " not in r and r.split(", ")[3] == "0" for r in overlaps_plain(rows, [tuple(r) for r in bench.collect()]))


def test_longest_match(spark):
    run = "bravo charlie delta echo foxtrot golf hotel india juliett kilo lima"
    docs = spark.createDataFrame([(1, f"zz alpha bravo {run} zz lemon lime"), (2, "lime"), (3, "alpha bravo")], "doc_id long, text string")
    got = {r.doc_id: (r.longest, r.longest_at, r.longest_item)
           for r in decontaminate.overlaps(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == {1: (11, 3, "1"), 2: (1, 0, "2"), 3: (0, None, None)}


def test_memory_of_a_block_is_linear_in_its_words():
    import tracemalloc

    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    items = [("long", long), *[(f"i{k}", f"q{k} w1 w2 w3 w4 w5 w6 w7 w8 w9 e{k}") for k in range(2000)]]
    ws = long.split()
    tracemalloc.start()
    block = decontaminate.Items(items, 10)
    texts = [ws, ["z", *ws[500:700], "z", *ws[3:16]], "q7 w1 w2 w3 w4 w5 w6 w7 w8 w9 e7".split(), ["z"]]
    got = decontaminate.search_shard(block, [[w.encode() for w in t] for t in texts])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000  # a row of the longest item's length a suffix would be 6.7 GB
    assert got[0] == (20_000, [0, 20_000], ["long"], 20_000, 0, "long")
    assert got[1] == (215, [1, 201, 202, 215], ["long"], 200, 1, "long")
    assert got[2] == (11, [0, 11], ["i7"], 11, 0, "i7") and got[3] == (1, [], [], 0, None, None)


# --- quality rules
def measures_plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    threes = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if threes[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)


@pytest.mark.parametrize("which", ["odd", "small", "clashing", "none"])
def test_quality_measures(which, request):
    docs = request.getfixturevalue(which)
    got = quality_rules.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        m = measures_plain(r[1])
        want.append((r[0], *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:7]) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_keeps_good_and_rejects_junk(spark, small, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = quality_rules.quality(small).join(labels, "doc_id").where("n_words >= 50")
    rates = {r[0]: r[1] for r in both.groupBy("quality").agg({"kept": "count", "n_words": "count"}).collect()}
    kept = {r[0]: r[1] for r in both.where("kept").groupBy("quality").count().collect()}
    assert kept[1] >= 0.99 * rates[1] and kept.get(0, 0) <= 0.1 * rates.get(0, 0)


def test_quality_filter_keeps_columns(clashing):
    kept = quality_rules.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert by_row(kept.select("doc_id")) == by_row(quality_rules.quality(clashing).where("kept").select("doc_id"))


def test_sketches_add_up(odd):
    frame = quality_rules.quality(odd)
    apart = quality_rules.sketches(frame)
    again = quality_rules.merge(quality_rules.merge(apart, "lang", "source"), "lang")
    assert by_row(again) == by_row(quality_rules.merge(apart, "lang"))


# --- secrets
KINDS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
          2, 6), ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 1, 20), ("hex", re.compile(r"([0-9a-f]+)"), 1, 24)]


def spans_plain(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), n, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


@pytest.mark.parametrize("which", ["odd", "small", "clashing", "none"])
def test_secret_spans(which, request):
    docs = request.getfixturevalue(which)
    got = secrets.secrets(docs).select("doc_id", secrets.text_of(__import__("pyspark").sql.functions.col("spans"), secrets.BASE))
    want = [(r[0], ",".join(spans_plain(r[1]))) for r in docs.select("doc_id", "text").collect()]
    assert by_row(got) == sorted(map(repr, want))


def test_ownership_tells_examples_from_live(spark):
    same, own = "password=copied1example", "password=only9mine4ever"
    rows = [(i, f"x {same} y", "en", f"s{i}") for i in range(5)] + [(9, f"{own} and {same}", "en", "s9"), (10, own, "en", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_live, r.n_example) for r in secrets.secrets(docs).collect()}
    assert got[0] == (0, 1) and got[9] == (1, 1) and got[10] == (1, 0)
    masked = {r.doc_id: r.text for r in secrets.mask_live(docs).collect()}
    assert masked[9] == f"password=[secret] and {same}" and masked[0] == f"x {same} y"


def test_masking_keeps_columns_and_rows(clashing):
    got = secrets.mask_live(clashing)
    assert got.columns == clashing.columns and got.count() == clashing.count()


def pem(seed, label="RSA PRIVATE KEY", end=True):
    body = [hashlib.sha512(f"{seed}{i}".encode()).hexdigest()[:64] for i in range(4)] + [f"Q{seed}kz=="]
    return "\n".join([f"-----BEGIN {label}-----", *body, *([f"-----END {label}-----"] if end else [])])


def test_private_keys_are_masked_whole(spark):
    copied = pem("shared")
    headed = pem("h").replace("KEY-----\n", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n", 1)
    texts = [f"a {pem(i)} z\n{copied}" for i in range(5)] + [
        f"a {headed} z", f"a {pem('e').replace(chr(10), chr(92) + 'n')} z", "a " + pem("p", "PGP PRIVATE KEY BLOCK") + " z",
        "a " + pem("cut", end=False) + "\nmore prose", "-----BEGIN RSA PRIVATE KEY----- " * 3000 + "z"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.text for r in secrets.mask_live(docs).collect()}
    assert [got[i] for i in range(5)] == [f"a [secret] z\n{copied}"] * 5  # own keys go, the copied example stays
    assert [got[i] for i in (5, 6, 7)] == ["a [secret] z"] * 3
    assert got[8] == "a [secret]\nmore prose"


def test_secrets_of_letters_or_digits_alone_are_masked(spark):
    key = "AKIA" + "QWERTYUIOPASDFGH"
    texts = ["password=CorrectHorseBattery, CorrectHorseBattery", f"x {key} y", "token: 8203947561", "secret: finding a finding",
             "password=changeme token=your_token_here api_key=os.environ secret=xxxxxxxx"] + ["password=CommonExampleWord"] * 4
    docs = spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.text for r in secrets.mask_live(docs).collect()}
    assert got[0] == "password=[secret], [secret]" and got[1] == "x [secret] y" and got[2] == "token: [secret]"
    assert got[3] == "secret: [secret] a finding"
    assert [got[i] for i in range(4, 9)] == texts[4:]


def test_rows_without_an_id_are_masked(spark):
    rows = [(None, "password=only9mine4ever", "en", "s1"), (None, "token=other7value5here", "en", "s2"), (None, None, "en", "s3"),
            (1, "prose", "en", "s4"), (2, "password=third8value6here", "en", "s5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.source: r.text for r in secrets.mask_live(docs).collect()}
    assert got == {"s1": "password=[secret]", "s2": "token=[secret]", "s3": None, "s4": "prose", "s5": "password=[secret]"}
