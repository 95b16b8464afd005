"""Each operator against brute force, and on rows that are odd."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcefacts.llm import chat, decontamination as D, jaccard_join as J, language_id as L, packing as P, pii, quality as Q, sharding as S, token_files as T
from sourcefacts.llm.components import connected_components
from sourcefacts.llm.tokens import encoder, vocabulary

LONG = " ".join(f"word{i % 700}" for i in range(20_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, ids=None):
    rows = [((ids[i] if ids else i), t, "en", "src0" if i % 2 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = (None, "", "   \n\t ", "x", "a b c", "ÄÖ ñ 日本 語", LONG, LONG, "same text here " * 4, "same text here " * 4)


def test_empty_tables(spark):
    none = docs(spark)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from sourcefacts.llm import toxicity

    for out in (S.assign_shards(none, 24), Q.quality_report(none), D.contamination_report(none, bench), P.pack_documents(none), J.similarity_report(none), T.token_digest(spark, none), pii.pii_digest(none), L.language_report(none), toxicity.toxicity_report(none, labels), J.keep_representatives(none), Q.keep_good(none), D.drop_contaminated(none, bench), pii.sanitise(none)):
        assert out.count() == 0


# ---- sharding


def jump_by_hand(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * S.JUMP_MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = [0, 1, 7, -1, 2**62, *random.Random(1).sample(range(2**40), 200)]
    for n in (1, 2, 24, 25, 1000):
        assert S.jump_hash(np.array(keys, dtype=np.int64), n).tolist() == [jump_by_hand(k % 2**64, n) for k in keys]


def test_shards(spark):
    rows = S.assign_shards(docs(spark, *ODD, ids=[None, 5, 5, *range(7)]), 24).collect()
    assert len(rows) == len(ODD)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in ODD)


def test_shards_of_one_hot_row(spark):
    same = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    assert sorted(r["slot"] for r in S.assign_shards(same, 24).collect()) == list(range(5000))


# ---- quality


def rules_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows, hit = {}, set()
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    for spots in windows.values():
        if len(spots) > 1:
            hit.update(k for i in spots for k in range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_rules(spark):
    rng = random.Random(2)
    texts = [*ODD, *["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "\t", "é"]) for _ in range(rng.randrange(200))) for _ in range(60)]]
    got = {r["doc_id"]: tuple(r)[1:7] for r in Q.quality_report(docs(spark, *texts)).collect()}
    assert got == {i: rules_by_hand(t) for i, t in enumerate(texts)}


def test_bad_host_goes(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good if i < 50 or i == 99 else bad, "en", "fine" if i < 50 else "poor", 1) for i in range(100)]
    kept = {r["doc_id"] for r in Q.keep_good(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(range(50))


def verdicts_by_hand(rows):
    """What the host-level verdict keeps of (id, host, text) rows."""
    counts = {i: (h, rules_by_hand(t), t) for i, h, t in rows}
    failed = {}
    for i, (h, (n, _, symbols, dup, _, base), t) in counts.items():
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))
        failed[i] = (base, 100 * dup > 30 * lines, symbols > n)
    hosts = {}
    for i, (h, *_) in counts.items():
        hosts.setdefault(h, []).append(failed[i])
    rates, often = {}, set()
    for k in range(3):
        each = {h: (sum(f[k] for f in v), len(v)) for h, v in hosts.items()}
        mean = sum(f for f, _ in each.values()) / sum(n for _, n in each.values())
        shares = [f / n for f, n in each.values()]
        chance = mean * (1 - mean)
        between = (np.var(shares, ddof=1) if len(shares) > 1 else 0.0) - chance * np.mean([1 / n for _, n in each.values()])
        strength = max(chance / between - 1, 1.0) if between > 0 else None
        for h, (f, n) in each.items():
            rates[h, k] = mean if strength is None else (f + strength * mean) / (n + strength)
            if strength is not None and rates[h, k] - 2 * np.sqrt(rates[h, k] * (1 - rates[h, k]) / (n + strength + 1)) > 1.25 * mean:
                often.add((h, k))
    return {i for i, (h, *_) in counts.items() if not failed[i][0] and rates[h, 0] <= 0.5 and not any(failed[i][k] and (h, k) in often for k in (1, 2))}


def test_host_verdicts(spark):
    # one host often has more symbols than words, one once in a hundred, one is bad throughout
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = lambda: " ".join(word() for _ in range(30))
    junk = lambda: " ".join(word() + "%%%" for _ in range(30))
    dup = lambda: "\n".join([good()] * 1 + [word()] * 6)
    rows = [(i, "often", junk() if i % 5 == 0 else good()) for i in range(100)]
    rows += [(i, "once", junk() if i == 100 else dup() if i == 101 else good()) for i in range(100, 300)]
    rows += [(i, "bad", "too short" if i % 10 else good()) for i in range(300, 360)]
    rows += [(i, None, dup() if i % 2 else good()) for i in range(360, 400)]
    table = spark.createDataFrame([(i, t, "en", h, 1) for i, h, t in rows], DOCS)
    kept = {r["doc_id"] for r in Q.quality_report(table).where("kept").collect()}
    assert kept == verdicts_by_hand(rows) == {r["doc_id"] for r in Q.keep_good(table).collect()}
    assert 0 not in kept and 100 in kept and 101 in kept and 1 in kept
    assert not kept & set(range(300, 360)) and 361 not in kept and 360 in kept


def test_doubts_are_forgiven_where_hosts_are_alike(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda sign: " ".join(word() + sign for _ in range(30))
    alike = [(i, f"h{i % 4}", text("%%%" if i // 4 % 10 == 0 else "")) for i in range(400)]
    table = lambda rows: spark.createDataFrame([(i, t, "en", h, 1) for i, h, t in rows], DOCS)
    assert Q.quality_report(table(alike)).where("not kept").count() == 0 and len(verdicts_by_hand(alike)) == 400
    # the same doubts, but one host has most of them
    apart = [(i, "h0" if "%" in t and i % 7 else f"h{1 + i % 3}", t) for i, h, t in alike] + [(1000 + i, "h0", text("")) for i in range(60)]
    kept = {r["doc_id"] for r in Q.quality_report(table(apart)).where("kept").collect()}
    assert kept == verdicts_by_hand(apart)
    gone = {i for i, h, t in apart if h == "h0" and "%" in t}
    assert gone and kept == {i for i, *_ in apart} - gone


def test_rules_keep_clashing_columns(spark):
    odd = docs(spark, "a b c d e f g h i j k l").withColumn("n_words", F.lit("mine")).withColumn("_host", F.lit(1)).withColumn("kept", F.lit(2))
    out = Q.keep_good(odd)
    assert out.columns == odd.columns
    assert out.first()["n_words"] == "mine"


# ---- language


def test_cross_parsing_counts():
    parser = L.CrossParser.fit({"a": ["abcabcabd"], "b": ["zzxy"]})

    def greedy(text, sample):
        n, at = 0, 0
        while at < len(text):
            k = 1
            while at + k <= len(text) and text[at : at + k] in sample:
                k += 1
            at += max(1, k - 1)
            n += 1
        return n

    for text in ("abcabd", "zzz", "abzxyq", "q", "cabcab"):
        got = parser.phrases([L.letters_of(text)])[0]
        assert abs(int(got[0]) - greedy(text, "abcabcabd ")) <= 1
        assert abs(int(got[1]) - greedy(text, "zzxy ")) <= 1


def test_letters_of_large_scripts_are_told_apart():
    # two scripts of hundreds of letters each beside a frequent Latin text
    rng = random.Random(9)
    scripts = {"han": range(0x4E00, 0x4E00 + 600), "hangul": range(0xAC00, 0xAC00 + 600)}
    words = {k: ["".join(chr(rng.choice(v)) for _ in range(2)) for _ in range(400)] for k, v in scripts.items()}
    words["latin"] = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(400)]
    make = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    samples = {k: [make(k, 2000)] for k in words}
    parser = L.CrossParser.fit(samples)
    tests = [(k, make(k, 30)) for k in words for _ in range(20)] + [("latin", make("latin", 30) + chr(0x4E00) + chr(0x1200))]
    assert parser.predict([t for _, t in tests])[0] == [k for k, _ in tests]
    # the same phrases as a greedy search in the sample gives
    grown = [np.append(L.letters_of(samples[k][0]), 32)[: L.SAMPLE_LETTERS] for k in sorted(words)]
    for _, text in tests[::7]:
        coded = L.letters_of(text)
        for sample, got in zip(grown, parser.phrases([coded])[0], strict=True):
            sample, part, n, at = "".join(map(chr, sample)), "".join(map(chr, coded)), 0, 0
            if not set(part) <= set(sample):
                continue
            while at < len(part):
                size = 1
                while at + size < len(part) and part[at : at + size + 1] in sample:
                    size += 1
                n, at = n + 1, at + size
            assert abs(int(got) - n) <= 1


def test_language(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = L.language_report(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.85
    odd = L.identify(docs(spark, None, "", "123 !!", "the and"), L.CrossParser.fit({"en": ["the and of"], "fr": ["le la et"]})).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in odd)


def test_languages_of_long_texts_are_learned(spark):
    # every text of one language is long, and begins with what is no letter
    words = {"long": ["tulip", "ember", "crane"], "short": ["gravo", "simul", "honti"]}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(words["short"]) for _ in range(50)), "short", "s", 1) for i in range(10)]
    rows += [(i, "7 " * 9000 + " ".join(rng.choice(words["long"]) for _ in range(4000)), "long", "s", 1) for i in range(10, 14)]
    sample = L.labelled_sample(spark.createDataFrame(rows, DOCS), F.lit(True))
    assert set(sample) == {"long", "short"}
    assert all("tulip" in t and len(t) <= L.SAMPLE_DOC_CHARS for t in sample["long"])
    assert L.CrossParser.fit(sample).predict(["crane tulip ember", "honti gravo"])[0] == ["long", "short"]


# ---- decontamination


def test_contamination(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "cd", "Ef", "gh", "ïj"])
    items = [(0, " ".join(word() for _ in range(14))), (1, "only three words"), (2, None), (3, "..."), (None, "ab cd"), (4, "only three words")]
    texts = [*ODD, items[0][1] + " tail", "x, ONLY-three.words y", *[" ".join(word() for _ in range(80)) for _ in range(30)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    def by_hand(text):
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - 9)) if v and item is not None else ():
                part = v[k : k + 10]
                for i in range(len(w) - len(part) + 1):
                    if w[i : i + len(part)] == part:
                        hit.update(range(i, i + len(part)))
                        found.add(str(item))
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    want = {i: by_hand(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: tuple(r)[1:] for r in D.contamination_report(docs(spark, *texts), bench).collect()} == want
    # the same from several blocks
    found = D.find_contamination(docs(spark, *texts), bench, block_bytes=30)
    assert {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"])) for r in found.collect()} == {i: w[:3] for i, w in want.items()}
    kept = D.drop_contaminated(docs(spark, *texts).withColumn("_hash", F.lit(0)), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in want.items() if not w[4])


def test_proximity(spark):
    index = D.build_index(docs(spark, "a x x b", "a x x x x x b", "b a", None), segment_words=6)
    out = D.proximity_matches(index, {"ab": [b"a", b"b"]}, slop=3)
    assert {r["doc_id"] for r in out.collect() if r["items"]} == {0, 2}


# ---- packing and tokens


def test_plan_is_whole():
    rng = random.Random(4)
    for n in (1, 3, 40, 3000):
        histogram = {}
        for _ in range(n):
            s = rng.randint(1, 63)
            histogram[s] = histogram.get(s, 0) + 1
        rows = P.plan_sequences(histogram, 64)
        taken, load = {}, {}
        for size, first, count, each, sequence in rows:
            assert first == taken.get(size, 0)
            taken[size] = first + count
            for q in range(count // each):
                load[sequence + q] = load.get(sequence + q, 0) + size * each
        assert taken == histogram
        assert max(load.values()) <= 64
        assert sorted(load) == list(range(len(load)))
        assert n < 1000 or sum(load.values()) / (64 * len(load)) > 0.98


def test_packing(spark):
    table = docs(spark, *ODD, ids=[None, 1, 1, *range(2, 9)])
    rows = P.pack_documents(table, keep_ids=True).collect()
    enc = encoder(vocabulary("byte_bpe_50k.json"))
    want = sorted(enc.whole(t or "") + b"\0\0\0\0" for t in ODD)
    by_sequence = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(len(r["ids"]) for r in rows) == sum(map(len, want))
    packed = P.build_sequences(P.pack_documents(table, keep_ids=True)).collect()
    assert sum(len(r["ids"]) for r in packed) == sum(map(len, want))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_the_whole(name):
    enc = encoder(vocabulary(name))
    rng = random.Random(5)
    texts = [t for t in ODD if t] + ["Σ aΣ", "a\r\nb", "x  y", "<|endoftext|> a", "don't we'll  ok", "İstanbul it's", "a\n\nb ", "é̀ é", "a b", "​ x"]
    texts += ["".join(rng.choice("abcDÉ ñ\n'1 ,.%　日\t ") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert enc.encode(t) == enc.whole(t), repr(t)


def test_token_files(spark, tmp_path):
    table = docs(spark, *ODD, ids=[None, 9, 9, 3, 4, 5, 1, 2, 8, 8])
    folder = str(tmp_path / "ids")
    enc = encoder(vocabulary("word_bpe_49k.json"))
    files = T.write_token_files(table, folder, vocabulary("word_bpe_49k.json"), 2, partitions=3)
    rows = T.read_token_files(spark, folder, files).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 8, 8, 9, 9]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert sorted(bytes(r["ids"]) for r in rows) == sorted(enc.whole(t or "") + b"\2\0\0\0" for t in ODD)
    # one document alone, and a damaged frame
    file = next(r["file"] for r in files.collect() if 5 in T.fetch_documents(folder, r["file"], [5]))
    got = T.fetch_documents(folder, file, [5])
    assert list(got) == [5] and got[5].tobytes() == enc.whole(ODD[5]) + b"\2\0\0\0"
    path = tmp_path / "ids" / file
    raw = bytearray(path.read_bytes())
    raw[len(raw) - 9 - 4] ^= 255  # the last frame's checksum
    path.write_bytes(raw)
    with open(path, "rb"), pytest.raises(T.Corrupt):
        import pyarrow as pa

        reader = T.FrameReader(pa.OSFile(str(path)))
        reader.frame(len(reader.entries) - 1)


def test_frames_are_plain_zstandard(tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    writer = T.FrameWriter(out, frame_bytes=64)
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (5, 40, 1, 0, 9)]
    for i, x in enumerate(ids):
        writer.add(i, x)
    writer.finish()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == b"".join(ids)


# ---- chat


def test_round_trip(spark):
    hard = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<\\\\|im_end|>\n", "plain", "", None, "a\n<|im_end|>\n<|im_start|>user\n", "<|", "日本<|im_end|>"]
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "us\ner", "<|r", "%0A", None, "assistant", "user", "assistant"], hard if c else reversed(hard), strict=True))]
    rows += [(9, None, "assistant", "x"), (9, 1, "assistant", "y"), (9, 1, "assistant", "y"), (None, 0, "user", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(table).collect()
    assert all(r["round_trip"] for r in out)
    for r in out:
        source = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [s[2:] for s in source]
        masked = "".join(r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"])
        assert re.sub(r"<\\(\\*)\|", r"<\1|", masked) == "".join(s[3] for s in source if s[2] == "assistant")
    assert chat.chat_digest(table).where("conv_id = -1").first()["n_turns"] == 2


def test_parser_refuses(spark):
    texts = ["x", "<|im_start|>user\nhello", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\na<|im_end|>\nb"]
    got = spark.createDataFrame([(t,) for t in texts], "f string").select(chat.parse(F.col("f")).alias("p")).collect()
    assert [r["p"] for r in got] == [None] * 4


# ---- near duplicates


def classes_by_hand(texts, size, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def crowd(seed):
    """Copies of a base with more and more edits, a passage in many texts, and others."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(400)}" for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts = list(ODD)
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    for _ in range(80):
        texts.append(passage + " " + " ".join(f"q{rng.randrange(60)}" for _ in range(rng.randrange(12))))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_near_duplicates(spark, monkeypatch, seed, size, percent):
    texts = crowd(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs(spark, *texts), size, percent).collect()}
    assert got == dict(enumerate(classes_by_hand(texts, size, percent)))


def test_links_do_not_hang_on_the_orders(spark, monkeypatch):
    texts = crowd(3)
    want = dict(enumerate(classes_by_hand(texts, 4, 85)))
    for name, value in (("RUN", 3), ("FREQUENT_DOCS", 10**9), ("BLOCK_TOKENS", 300), ("BLOCK_SET", 1)):
        monkeypatch.setattr(J, name, value)
    frequent = J.FrequentTokens([], [], [])
    table = docs(spark, *texts)
    signed = J.materialize(J.sign_documents(table, 4), "s")
    prefixes = J.materialize(J.prefix_rows(table, frequent, 4, 85, "doc_id", "text"), "p")
    # short runs only on this side: the task reads its own RUN
    pairs = J.connected_components(J.candidate_links(prefixes, 85), "a", "b").collect()
    cluster = {r["node"]: r["component"] for r in pairs}
    node = {r["doc_id"]: r["node"] for r in signed.where("n is not null").collect()}
    for i, (_, c) in want.items():
        if node[i] is not None and node[i] != node[c]:
            assert cluster[node[i]] == cluster[node[c]]
    links = J.materialize(J.similar_links(table, signed, 4, 85), "l")
    found = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    for i, (_, c) in want.items():
        if node[i] is not None and node[i] != node[c]:
            assert found[node[i]] == found[node[c]]


def test_representatives(spark):
    texts = ["w " * 3 + " ".join(f"a{i}" for i in range(30)), " ".join(f"c{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40)), None, None, ""]
    table = docs(spark, *texts, ids=[5, 2, 2, 7, 7, 1]).withColumn("_row", F.lit(1)).withColumn("node", F.lit(2))
    out = J.keep_representatives(table)
    assert out.columns == table.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 5, 7, 7]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 250), (250, 201), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200, 250: 200}


# ---- personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def spans_by_hand(text):
    def luhn(d):
        t = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            t += v - 9 if v > 9 else v
        return t % 10 == 0

    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    rng = random.Random(6)
    texts = [t or "" for t in ODD] + ["a@b.co_x@d.org", "é@x.y a@b.c", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "4111 1111-1111 1111 4111111111111112", "+1 (499) 555-6503%% +1", "9" * 3000, "a" * 5000 + "@", "1 " * 4000, "🙂 a@b.cd 🙂 +49 1234 5678"]
    texts += ["".join(rng.choice("ab1245.@+- ()_é") for _ in range(120)) for _ in range(150)]
    got = {r["doc_id"]: r for r in pii.pii_digest(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        want = spans_by_hand(t)
        assert got[i]["spans"].split(",term:")[0].removeprefix("term:") == want or got[i]["spans"].startswith(want), t[:80]
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["n_email"] == want.count("email:")


def test_disclosing_terms(spark):
    # a nickname that stands with one address only, in different lines, and words that are everywhere
    rows = [f"report {i} says zorro wrote from zz@mail.org about item{i}" for i in range(6)] + [f"report {i} says somebody wrote about item{i}" for i in range(40)] + ["zorro alone, no address"]
    table = docs(spark, *rows)
    found = {r["_row"]["doc_id"]: r for r in pii.find_disclosures(table, ["doc_id"]).collect()}
    assert {s["value"] for s in found[0]["spans"] if s["kind"] == len(pii.KINDS)} >= {"zorro"}
    assert "report" not in {s["value"] for r in found.values() for s in r["spans"]}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert "zz@mail.org" not in clean[0] and "zorro" not in clean[0] and "[EMAIL]" in clean[0]
    assert all(clean[i] == rows[i] for i in range(6, len(rows)))
    odd = table.withColumn("spans", F.lit(1)).withColumn("_text", F.lit("mine"))
    assert pii.sanitise(odd).columns == odd.columns


def test_rare_entities_are_disclosed(spark):
    # seen once, seen twice with the term in another line than the address, and four copies of one text
    rows = ["the note of quillon to once@mail.org"] + [f"{w} brimble is here\nthe note went to twice@mail.org" for w in ("first", "second")] + ["the note of copperby to copies@mail.org"] * 4 + ["the note is here to stay of first and second"] * 60
    found = {r["_row"]["doc_id"]: r for r in pii.find_disclosures(docs(spark, *rows), ["doc_id"]).collect()}
    terms = [[(s["value"], s["action"]) for s in found[i]["spans"] if s["kind"] == len(pii.KINDS)] for i in range(len(rows))]
    assert terms[0] == [("quillon", "remove")]
    assert terms[1][0] == ("brimble", "remove") == terms[2][0]
    assert all(terms[i] == [("copperby", "remove")] for i in range(3, 7))
    assert not any(terms[7:])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, *rows)).collect()}
    assert clean[0] == "the note of  to [EMAIL]"


def test_terms_are_marked_everywhere(spark):
    rows = [f"report {i} says zorro wrote from zz@mail.org about item{i}" for i in range(6)] + [f"report {i} says somebody wrote about item{i}" for i in range(40)] + ["zorro alone, no address"]
    found = {r["_row"]["doc_id"]: r["spans"] for r in pii.find_disclosures(docs(spark, *rows), ["doc_id"], everywhere=True).collect()}
    assert [(s["value"], s["start"], s["action"]) for s in found[46]] == [("zorro", 0, "remove")]
    assert not any(found[i] for i in range(6, 46))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, *rows), everywhere=True).collect()}
    assert clean[46] == " alone, no address" and all(clean[i] == rows[i] for i in range(6, 46))


def test_hot_rows_are_numbered_in_units(spark, monkeypatch):
    monkeypatch.setattr(S, "UNIT_ROWS", 7)
    same = spark.range(100).select((F.col("id") % 2).alias("doc_id"), F.lit("t").alias("text"))
    rows = S.assign_shards(same, 24).collect()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert len(rows) == 100


# ---- toxicity


def test_toxicity_restores_words(spark):
    from sourcefacts.llm import deobfuscation as B, toxicity as X

    rng = random.Random(7)
    plain = ["water", "table", "garden", "morning", "letter", "window", "summer", "bridge"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(plain) for _ in range(20)]
        if bad:
            w[rng.randrange(20)] = rng.choice(["grumbo", "snarfle"])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    table = spark.createDataFrame(rows, DOCS)
    model = X.fit(X.labelled_texts(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True)), B.letter_model(table))
    tests = ["water gr0mbo gRuMb0 table", "the g r u m b o here", "snaaaarfle water", "$narf1e", "water table", None, "", LONG]
    got = {r["doc_id"]: r["score"] for r in X.text_evidence(docs(spark, *tests), model).collect()}
    assert all(got[i] >= 0.5 for i in range(4)), got
    assert all(0 <= got[i] < 0.5 for i in range(4, 8)), got


def test_every_kind_of_disguise_is_read():
    from sourcefacts.llm import deobfuscation as B

    plain = ["stupid", "idiot", "bastard", "ass", "grumbo", "water", "letter", "garden", "morning"]
    restorer = B.Restorer(B.LetterModel(B.trigram_counts(iter([" ".join(plain)] * 200))))
    for token, word in [("stuupid", "stupid"), ("iidiot", "idiot"), ("b@stard.x", "bastard"), ("@$$", "ass"), ("-".join(["water"] * 9 + ["stup1d"]), "stupid"), ("/".join(["garden"] * 8 + ["b@stard"]), "bastard"), ("_".join(["s.t.u.p.1.d"] * 5), "stupid")]:
        assert any(word in w for w in restorer.words(token)), (token, restorer.words(token))
    assert B.is_disguised("b@st.rd") and not B.is_disguised("https://a.org/b00k") and not B.is_disguised("12345")
    assert "letter" in restorer.words("letter") and restorer.words("water") == ["water"]


# ---- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in C.STAGES] and len(C.STAGES) == 5
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    want = verdicts_by_hand([(r["doc_id"], r["source"], r["text"]) for r in table.collect()])
    step = C.materialize(C.STAGES[0][1](spark, table, sf_dir), "stage")
    assert step.columns == table.columns and {r["doc_id"] for r in step.collect()} == want
    ids = sorted(want)
    classes = classes_by_hand([texts[i] for i in ids], 5, 80)
    want = {ids[c] for _, c in classes}
    step = C.materialize(C.STAGES[1][1](spark, step, sf_dir), "stage")
    assert step.columns == table.columns and {r["doc_id"] for r in step.collect()} == want
    report = {r["doc_id"]: r["contaminated"] for r in D.contamination_report(table, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    want = {i for i in want if not report[i]}
    step = C.materialize(C.STAGES[2][1](spark, step, sf_dir), "stage")
    assert {r["doc_id"] for r in step.collect()} == want
    step = C.materialize(C.STAGES[3][1](spark, step, sf_dir), "stage")
    assert step.columns == table.columns and {r["doc_id"] for r in step.collect()} == want
    assert not [r for r in step.collect() if re.search(PATTERNS[0][1], r["text"])]
    packed = C.STAGES[4][1](spark, step, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == want


def test_oracles(spark, sf_dir):
    import duckdb

    from sourcefacts.llm import queries

    c = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf_dir)
        columns = sorted(got.columns)
        want = c.sql(sql)
        assert columns == sorted(want.columns)
        assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.project(", ".join(f'"{x}"' for x in columns)).fetchall())), json.dumps(name)
