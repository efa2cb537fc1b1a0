"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import licenses, mixing, neighbours, ngram_join, packing, quality_classifier, quality_rules, sharding, suffix_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, s int, start string, key int, id string, bands int, shard int, x int, _id int, starts int, digest int, text_hash int, items int, hash int"


def words(t):
    return WORD.findall(t or "")


def corpus():
    rnd = random.Random(4)
    w = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choices(w, k=n))
    base, passage = say(120), say(60)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "  \n\t ", "one", "two words", "a b c d e", "a b c d e", base, base, " ".join(near), base + " tail end", passage + ". " + say(30), say(25) + " " + passage, passage, say(30_000), "é" * 150 + " ünï " + "é" * 150, say(40) + "\nReleased under the MIT License.\nAll rights reserved.\n" + say(5), "Released under the MIT License. Next.", "x\x00y " * 60, ("loop me again and again\n" * 30), "same line here\n" * 5 + say(20), "### $$$ " * 30, "ONE TWO!! " * 40]
    rows = [(i, t, "en", [None, "b", "a", "c"][i % 4]) for i, t in enumerate(texts)]
    rows += [(7, base, "en", "c"), (None, base, "en", "b"), (None, None, None, None)]
    rows += [(100 + k, base, "fr", "a") for k in range(12)]
    return [(*r, None, 1, 2, "3", 4, "5", 6, 7, 8, 9, 10, 11, 12, 13, 14) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_rules(docs, none):
    def brute(t):
        w = words(t)
        g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)

    want = Counter((r[0], *brute(r[1])) for r in corpus())
    got = quality_rules.judge(quality_rules.ledger(docs))
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    entries = quality_rules.ledger(docs)
    bits = [r.fail_bits for r in entries.collect()]
    for r in quality_rules.ablation(entries).collect():
        bit = 1 << next(x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only, r.n_docs) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), len(bits))
    assert quality_rules.ledger(none).count() == 0
    assert {r.n_failed for r in quality_rules.ablation(quality_rules.ledger(none)).collect()} == {0}


def test_mixing(docs, none):
    index, src = mixing.indexed(docs)
    runs = mixing.mix(index, src).collect()
    sizes = {(r.s, r.start): r["size"] for r in index.collect() if r["size"]}
    assert sum(index.select("size").toPandas()["size"]) == sum(len(words(r[1])) for r in corpus())
    taken, places = Counter(), set()
    for r in runs:
        assert (r.s, r.start) in sizes and 0 <= r.from_word and r.from_word + r.n_words <= sizes[r.s, r.start]
        taken[r.s, r.start] += r.n_words
        for k in range(r.n_words):
            assert (r.shard, r.slot, r.place + k) not in places
            places.add((r.shard, r.slot, r.place + k))
    assert all(n <= 3 * sizes[k] for k, n in taken.items())
    for r in src.collect():
        assert sum(n for k, n in taken.items() if k[0] == r.s) == min(round(r.target), 3 * r.source_size)
    names = [r.source for r in src.orderBy("s").collect()]
    assert names == ["a", "b", "c", None]
    again = mixing.mix(index.repartition(7), src).collect()
    assert Counter(map(tuple, runs)) == Counter(map(tuple, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count()
    index, src = mixing.indexed(none)
    assert mixing.mix(index, src).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixed_documents_keeps_rows_without_own_id(spark, docs):
    """One source's target is its size, so each row comes once, unchanged: null ids, one id under two texts, equal rows."""
    rows = [(None, f"no id {k} " + "w " * k, "a") for k in range(40)] + [(7, "one text", "a"), (7, "other text", "a"), (7, "a third and longer text", "a"), (8, "same", "a"), (8, "same", "a"), (9, " ", "a"), (None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert rows_of(mixing.mixed_documents(df), "doc_id", "text", "source") == Counter(r for r in rows if words(r[1]))
    taken, want = Counter(), Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[r.source] += len(words(r.text))
    for r in mixing.indexed(docs)[1].collect():
        want[r.source] = min(round(r.target), 3 * r.source_size)
    assert taken == want


def test_mix_against_plain_python(spark, docs):
    """Shards' draws, numbers, corrections and the words taken of each document, in plain Python from the same hashes."""
    index, src = mixing.indexed(docs)
    source = {r.s: r for r in src.collect()}
    total = sum(r.slots for r in source.values())
    drawn = spark.range(total).select(F.floor(F.col("id") / mixing.SHARD_SLOTS).alias("shard"), (F.col("id") % mixing.SHARD_SLOTS).alias("slot"))
    drawn = drawn.withColumn("x", F.pmod(F.xxhash64(F.lit(0), "shard", "slot"), F.lit(total))).orderBy("shard", "slot").collect()
    number, spare, takes = Counter(), {}, {}
    owner = [s for s in sorted(source) for _ in range(source[s].slots)]
    for r in drawn:
        s = owner[r.x]
        if number[s] < source[s].slots:
            takes[r.shard, r.slot] = (s, number[s])
        else:
            spare.setdefault(s, []).append((r.shard, r.slot))
        number[s] += 1
    free = [place for s in sorted(spare) for place in spare[s]]
    missing = [(s, j) for s in sorted(source) for j in range(number[s], source[s].slots)]
    assert len(free) == len(missing) > 0
    takes |= dict(zip(free, missing))
    counts = mixing.shard_counts(src)[1].collect()
    assert Counter({(r.shard, r.s): r.n for r in counts}) == Counter((r.shard, owner[r.x]) for r in drawn)
    got = mixing.slots(src).collect()
    per = lambda r: (source[r.s].blocks, source[r.s].full_blocks)
    assert len(got) == total and Counter((r.shard, r.slot, r.s, r["pass"]) for r in got) == Counter((*place, s, j // source[s].blocks) for place, (s, j) in takes.items())
    for s, own in source.items():
        for k in range(int(own.slots // own.blocks)):
            assert sorted(r.block for r in got if r.s == s and r["pass"] == k) == list(range(own.blocks))
        assert all(r.block < per(r)[0] for r in got if r.s == s)
    words_of = {(r.s, r.start): r["size"] for r in index.collect() if r["size"]}
    taken = Counter()
    for r in got:
        for (s, start), size in words_of.items():
            if s == r.s:
                taken[s, start] += max(0, min(start + size, r.block * mixing.BLOCK + r.n_take) - max(start, r.block * mixing.BLOCK))
    want = Counter((words_of[k], n) for k, n in taken.items())
    assert want == Counter((r["size"], r.taken) for r in mixing.takes(docs).collect() if r["size"])


def test_targets_by_hand(spark):
    """100 words, weights 1, 2, 3: the last source stops at 3 * 10, and the other two share 70 as 1 : 2."""
    sizes = spark.createDataFrame([("a", 60), ("b", 30), ("c", 10)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got == pytest.approx({"a": 70 / 3, "b": 140 / 3, "c": 30})


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), 5).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_license_scan(docs, none):
    got = rows_of(licenses.scan(docs), "doc_id", "license", "rule", "n_sentences")
    assert got == Counter({(16, "MIT", "mit-notice-reserved", 2): 1, (17, "MIT", "mit-notice", 1): 1})
    assert licenses.scan(none).count() == 0


def test_license_scan_wrapped(spark):
    """Rules wrapped at any width, as comments and on one line; sentences still end at marks, blank lines and for one-line notices."""
    import textwrap

    rules = {b: (a, c) for a, b, c in licenses.RULES}
    mit, apache = rules["mit-text"][1], rules["apache-header"][1]
    texts = [("mit-text", f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{textwrap.fill(mit[0], w)}\n\n{textwrap.fill(mit[1], w)}\n\nTHE SOFTWARE IS PROVIDED") for w in (30, 70, 76, 80)]
    texts += [("mit-text", "/*\n" + textwrap.fill(" ".join(mit), 72, initial_indent=mark, subsequent_indent=mark).replace("\n", "\r\n") + "\n*/") for mark in ("# ", "// ", " * ", "; ", "-- ", "! ")]
    texts += [("apache-header", textwrap.fill(" ".join(apache), w, initial_indent=mark, subsequent_indent=mark, break_long_words=False)) for w in (40, 75, 999) for mark in ("", "# ")]
    texts += [("apache-header", "\n".join("# " + x for x in [*apache[:3], "", "    " + apache[3]])), ("mit-notice", "say more\nReleased under the MIT\nLicense.\nand on"), ("mit-notice-reserved", "Released under the\nMIT License. All rights\nreserved.\n"), ("mit-notice", "no end mark\nReleased under the MIT License\nno end mark")]
    texts += [(None, x) for x in ("Released under the\n\nMIT License.", "Released under the.\nMIT License.", "# Released under the\n#\n# MIT License.", "x released under the\nMIT License.", "Released under the\nMIT License and more", "Released\x01.\nunder the MIT License.", "Released\n" * 500)]
    df = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = Counter((k, rules[r][0], r, len(rules[r][1])) for k, (r, _) in enumerate(texts) if r)
    assert rows_of(licenses.scan(df), "doc_id", "license", "rule", "n_sentences") == want


def test_license_scan_shuffled(docs, monkeypatch):
    want = rows_of(licenses.scan(docs), "doc_id", "license", "rule", "first_sentence", "n_sentences")
    monkeypatch.setattr(licenses, "MAX_BROADCAST", 2)
    assert rows_of(licenses.scan(docs), "doc_id", "license", "rule", "first_sentence", "n_sentences") == want and want


def test_license_rules_find_themselves(spark):
    """Each rule's own text, in one line, wrapped and as a comment, gives that rule; a rule that holds others' sentences gives way to none."""
    import textwrap

    texts = [(k, shape(" ".join(said))) for k, (_, _, said) in enumerate(licenses.RULES) for shape in (str, lambda x: textwrap.fill(x, 60, break_long_words=False, break_on_hyphens=False), lambda x: textwrap.indent(textwrap.fill(x, 50, break_long_words=False, break_on_hyphens=False), " * "))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = rows_of(licenses.scan(df), "doc_id", "license", "rule")
    assert got == Counter((k, *licenses.RULES[k][:2]) for k, _ in texts)
    assert len({b for _, b, _ in licenses.RULES}) == len(licenses.RULES) > 200


def test_sharding(docs, none):
    for hot in (10_000, 2):
        got = sharding.shard(docs, shards=4, hot=hot).collect()
        want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        for k in range(4):
            slots = sorted(r.slot for r in got if r.shard == k)
            assert slots == list(range(len(slots)))
        assert all(len(s) == 1 for s in [{r.shard for r in got if r.group == g} for g in {r.group for r in got}])
    assert sharding.shard(none).count() == 0


def heap_schedule(sizes, shards):
    loads, out = [0] * shards, []
    for size in sorted(sizes, reverse=True):
        i = min(range(shards), key=lambda k: (loads[k], k))
        loads[i] += size
        out.append((size, i))
    return loads, Counter(out)


def test_schedule_is_longest_first():
    """Any number of groups of a size, dealt at once or not, as one by one."""
    for seed in range(30):
        rnd = random.Random(seed)
        sizes = Counter({rnd.randint(1, 900): rnd.choice([1, 3, 64, 65, 500, 2000]) for _ in range(rnd.randint(1, 40))})
        shards = rnd.choice([1, 3, 16])
        known = sorted(sizes.items(), reverse=True)
        got = Counter({(size, i): n for (size, _), own in zip(known, sharding.schedule(known, shards)) for i, n in enumerate(own) if n})
        assert got == heap_schedule(sizes.elements(), shards)[1]


def test_shards_are_those_of_a_heap(spark):
    """Bytes of each shard against a plain heap over all groups, with ties, repeats and one group of a third of all rows."""
    rnd = random.Random(6)
    rows = [(k, "x" * int(rnd.lognormvariate(3, 1))) for k in range(3000)] + [(k, "hot " * 40) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(df, shards=7).collect()
    sizes = Counter()
    for _, t in rows:
        sizes[t] += len(t) + 1
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    assert sorted(loads.values()) == sorted(heap_schedule(sizes.values(), 7)[0])
    # Many groups: near equal bytes.
    many = spark.createDataFrame([(k, f"{k} " + "y" * int(rnd.lognormvariate(4, 1))) for k in range(3000)], "doc_id long, text string")
    loads = [r.b for r in sharding.shard(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) <= 16


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    s = [shingles(r[1]) for r in rows]
    linked = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    links = [[j for j in range(len(s)) if j != i and linked(s[i], s[j])] for i in range(len(s))]
    group = list(range(len(s)))
    for _ in s:
        group = [min(group[j] for j in [i, *links[i]]) for i in range(len(s))]
    known = lambda g: min(((rows[i][0] is not None, rows[i][0] or 0) for i in range(len(s)) if group[i] == g))
    return Counter((rows[i][0], known(group[i])[1] if known(group[i])[0] else None, len(links[i])) for i in range(len(s)))


def test_near_duplicates(docs, none, monkeypatch):
    want = brute_near(corpus())
    assert rows_of(ngram_join.near_duplicates(docs), "doc_id", "class_id", "n_links") == want
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)  # groups in blocks
    assert rows_of(ngram_join.near_duplicates(docs), "doc_id", "class_id", "n_links") == want
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.deduplicated(docs)
    ids = [r.doc_id for r in kept.collect()]  # of a class, the least row; a null id is the least, here of two classes
    assert kept.columns == docs.columns and Counter(ids).most_common(2)[0] == (None, 2) and len(ids) == len(set(ids)) + 1 and not {0, 1, 7, 8, 9, 10, 100, 105} & set(ids)
    kept = ngram_join.deduplicated(docs.where("doc_id IS NOT NULL"))
    ids = sorted(r.doc_id for r in kept.collect())
    assert len(ids) == len(set(ids)) and 7 in ids and not {8, 9, 10, 100, 105} & set(ids)
    assert ngram_join.deduplicated(none).count() == 0


def test_banding():
    bands, rows = ngram_join.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MAX_HASHES


def brute_repeats(rows):
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = set(), {}
    for known, i, t in order:
        b = t.encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(mark[k] and (k == 0 or not mark[k - 1]) for k in range(len(b)))
        out[i if known else None, t] = (len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(b, mark) if not m)).hexdigest())
    return Counter((r[0], *out[r[0], r[1] or ""]) for r in rows)


@pytest.mark.parametrize("shard", [2_000_000, 3_000])
def test_suffix_dedup(docs, none, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "SECTION", 5_000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2_000)
    if shard < 10_000:
        monkeypatch.setattr(suffix_dedup, "FAN", 40)
        monkeypatch.setattr(suffix_dedup, "SEARCH", 50)
    assert rows_of(suffix_dedup.report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(corpus())
    assert suffix_dedup.report(none).count() == 0
    cut = suffix_dedup.trimmed(docs)
    assert cut.columns == docs.columns and all(words(r.text) for r in cut.collect())
    assert suffix_dedup.trimmed(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    want = Counter()
    for r in corpus():
        ids = [*encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[r[0], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.packed(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 2048) + 1
    assert packing.packed(none).count() == 0
    assert sum(len(r.ids) for r in packing.sequences(docs).collect()) == total


def plain_placing(sizes, length):
    """Sum-of-squares packing as it is defined: each piece, largest first, where the counts' squares sum to the least."""
    bins, at = [], []
    for size in sizes:
        counts = Counter(length - b for b in bins if b < length)
        best = None
        for gap in sorted(g for g in counts if g >= size):
            new = Counter(counts)
            new[gap] -= 1
            if gap > size:
                new[gap - size] += 1
            total = sum(n * n for n in new.values())
            if best is None or total < best[0]:
                best = (total, gap)
        if best is None:
            bins.append(0)
            k = len(bins) - 1
        else:
            k = max(i for i, b in enumerate(bins) if length - b == best[1])
        at.append(bins[k])
        bins[k] += size
    return at, sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_placing_is_sum_of_squares(seed):
    rnd = random.Random(seed)
    length = rnd.choice([10, 32, 64])
    sizes = np.array(sorted((rnd.randint(1, rnd.choice([length, length // 2, 4])) for _ in range(200)), reverse=True))
    sequence, offset = packing.placed(sizes, length)
    at, filled = plain_placing(sizes.tolist(), length)
    assert offset.tolist() == at and sorted(np.bincount(sequence, sizes).astype(int).tolist()) == filled


def test_groups_pack_apart(spark):
    """Many groups: sequences are whole, and each group wastes one at most."""
    rnd = random.Random(2)
    rows = [(k, 0, 0, min(2048, max(1, int(rnd.lognormvariate(5, 1.2)))), k) for k in range(5000)]
    parts = spark.createDataFrame(rows, "_id long, piece int, start long, length long, _row long").repartition(3)
    got = packing.pack(parts, group=500).toPandas().sort_values(["sequence_id", "offset"])
    g = got.groupby("sequence_id").length
    assert len(got) == 5000 and (g.cumsum() - got.length == got.offset).all() and g.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-sum(r[3] for r in rows) // 2048) + 10 * 2


def test_ids_are_the_tokenizers_own(monkeypatch):
    """Every letter of Unicode before a mark, other spaces, special tokens, marks that compose, long texts in parts."""
    import unicodedata

    encoder = packing.Encoder(packing.default_tokenizer())
    assert encoder.by_words and encoder.folds and encoder.splits
    rnd = random.Random(5)
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    texts = [" ".join(f"{a}{c}{m}" for c in letters[k::60] for a, m in ((rnd.choice(["", "a", "É", "e"]), rnd.choice([".", ",", "'s.", ""])),)) for k in range(60)]
    texts += ["", " ", "\x1f a.\x85b,\xa0c. <|endoftext|> x<|startoftext|>.", "İ. İ, क़. य়. ਲ਼, שׁ. e\u0301. E\u0301, ß. ÿ. Ÿ, ª. º, µ.", "I'M we'LL. don't, 12,5. a.b. a., a.. .a ,"]
    texts += ["".join(rnd.choices("abÉé.,' \n\t\x0bİ1\u0301", k=400)) for _ in range(60)]
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing._encoded(texts, encoder)] == whole
    monkeypatch.setattr(packing, "CHUNK", 500)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 100)
    encoder.forget()
    assert [x.tolist() for x in packing._encoded(texts, encoder)] == whole


def test_other_tokenizers_see_whole_texts(tmp_path):
    """One that keeps case, and one that joins over blanks."""
    import json

    import public_tokenizers

    cased = json.load(open(packing.default_tokenizer()))
    cased["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(cased))
    for path in (str(tmp_path / "cased.json"), public_tokenizers.path("byte_bpe_50k.json")):
        encoder = packing.Encoder(path)
        texts = ["One Two. two, ONE one", "", "  a  b\n\nc É. é, ", "x " * 50]
        assert not encoder.folds and [x.tolist() for x in packing._encoded(texts, encoder)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_warc(spark):
    pages = [(1, "http://a.example/x?q", '<html lang="de"><head><title>A &amp; B</title><script>var x="<p>";</script></head><body><!-- no --><p>One<br>two &lt;3</p><a href="/y">l</a></body></html>', "h"), (1, "http://a.example/x?q", "<p>One", "h"), (None, None, None, None), (3, "http://[bad", "<!-- never closed <p>x", ""), (4, "http://b.example", "5 < 6 <a title='>' href=q>k</a>", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, header string")
    got = warc.derivatives(warc.responses(df)).collect()
    assert len(got) == 10 and all(r.record_id != r.refers_to for r in got)
    text = {r.target_uri: r.block for r in got if r.record_type == "conversion"}
    assert text["http://b.example"] == "5 < 6 k" and text["http://[bad"] == ""
    first = next(r for r in got if r.record_type == "conversion" and "two" in r.block)
    assert first.block == "One\ntwo <3\nl"
    meta = next(r for r in got if r.record_type == "metadata" and r.refers_to == first.refers_to)
    assert "title: A & B\r\n" in meta.block and "language: de\r\n" in meta.block and "outlink: http://a.example/y\r\n" in meta.block
    assert f"source-payload-digest: {warc.digest(pages[0][2].encode())}\r\n" in meta.block
    for r in got:
        assert r.content_length == len(r.block.encode()) and f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and r.block_digest == warc.digest(r.block.encode())
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_warc_keeps_text_after_icons():
    got = warc.plain_text
    assert got('<p>a</p><svg class="i"/><p>rest of the page</p>') == "a\nrest of the page"
    assert got('<p>a</p><svg a="x>y" /><p>b</p><svg><text>no</text></svg>c') == "a\nb\nc"
    for kind in ("svg", "template", "noscript", "title"):
        assert got(f"<p>a</p><{kind} x=1><p>b</p><{kind.upper()}>c") == "a\nb\nc"
        assert got(f"<p>a</p><{kind}>no</{kind}><{kind}><p>b</p>") == "a\nb"
    for kind in ("script", "style", "textarea"):
        assert got(f"<p>a</p><{kind}>no<p>b</p>") == "a"
    assert got("<svg>" * 200_000 + "x") == "x"


def test_warc_headers_hold_one_line(spark):
    bad = "http://a/\r\n\r\nWARC-Type: response\x00\u2028 x"
    rows = [(1, "<urn:uuid:1>\r\nX: y", bad, "2020-01-01T00:00:00Z\r\nX: y", "HTTP/1.1 200 OK\nX: y\r\nServer: a\nX: y\r\n\r\n", "<a href='\r\nq'>l</a><title>t\r\nX: y</title>", "sha1:OWN\r\nX: y"), (2, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, warc_date string, http string, payload string, payload_digest string")
    got = warc.derivatives(df).collect()
    for r in got:
        assert r.header.count("WARC-Type:") == 1 + ("%0D%0AWARC-Type:" in r.header) and "\r\nX:" not in r.header and r.header.count("\r\n") == r.header.count("\n")
        assert "\nX:" not in r.block
    assert got[0].target_uri == bad and "WARC-Target-URI: http://a/%0D%0A%0D%0AWARC-Type:%20response%00%E2%80%A8%20x\r\n" in got[0].header
    assert "source-payload-digest: sha1:OWN X: y\r\n" in got[0].block


def test_warc_responses_are_read_with_their_own_headers(spark, tmp_path):
    import gzip

    def one(kind, rid, http, body, more=()):
        block = http.encode() + b"\r\n\r\n" + body
        head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Target-URI", "http://h/" + rid), ("WARC-Date", "2021-02-03T04:05:06Z"), *more, ("Content-Length", str(len(block)))]
        return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"

    plain = one("warcinfo", "i", "x", b"") + one("response", "a", "HTTP/1.1 200 OK\r\nX-Own: 1\r\nContent-Type: text/html; charset=latin-1", "é\r\n\r\nWARC/1.0".encode("latin-1"), [("WARC-Payload-Digest", "sha1:GIVEN")])
    chunked = one("response", "b", "HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked", b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n")
    packed = one("response", "c", "HTTP/1.1 200 OK\r\nContent-Encoding: gzip", gzip.compress("ü".encode()))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "p.warc").write_bytes(plain + packed + b"WARC/1.0\r\ntruncated")
    (tmp_path / "w" / "g.warc.gz").write_bytes(gzip.compress(chunked) + gzip.compress(one("request", "q", "GET /", b"")))
    (tmp_path / "w" / "e.warc").write_bytes(b"")
    read = warc.read(spark, str(tmp_path / "w"))
    got = {r.record_id: r for r in read.collect()}
    assert {k: r.payload for k, r in got.items()} == {"a": "é\r\n\r\nWARC/1.0", "b": "abcde", "c": "ü"}
    assert got["a"].payload_digest == "sha1:GIVEN" and got["a"].warc_date == "2021-02-03T04:05:06Z"
    meta = {r.refers_to: r for r in warc.derivatives(read, "record_id").collect() if r.record_type == "metadata"}
    assert "source-header: X-Own: 1\r\n" in meta["a"].block and "source-payload-digest: sha1:GIVEN\r\n" in meta["a"].block
    assert "source-status: HTTP/1.1 404 Not Found\r\n" in meta["b"].block and "WARC-Date: 2021-02-03T04:05:06Z\r\n" in meta["b"].header


def test_plain_text_against_a_parser(spark):
    """Every page of the small table, against the standard library's own HTML parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        hidden = {"script", "style", "noscript", "template", "title", "textarea", "svg"}
        block = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead tr ul".split())

        def __init__(self):
            super().__init__()
            self.out, self.deep = [], 0

        def handle_starttag(self, tag, attrs):
            self.deep += tag in self.hidden
            self.out.append(" " if tag in self.hidden else "\n" if tag in self.block else "")

        def handle_endtag(self, tag):
            self.deep -= tag in self.hidden
            self.out.append("\n" if tag in self.block else "")

        def handle_comment(self, data):
            self.out.append(" ")

        def handle_data(self, data):
            self.out.append("" if self.deep else data)

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        reader = Reader()
        reader.feed(r.html or "")
        reader.close()
        lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
        assert [" ".join(x.split()) for x in warc.plain_text(r.html or "").split("\n") if x] == [x for x in lines if x]


def test_warc_files_read_back(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://h/{k}", f"<p>text {k}\n\nmore") for k in range(9)], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(df))
    warc.write(records, str(tmp_path / "w"))
    seen = []
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            seen.append((re.search(rb"WARC-Record-ID: (\S+)", head)[1].decode(), data[:n].decode()))
            assert data[n : n + 4] == b"\r\n\r\n"
            data = data[n + 4 :]
    assert sorted(seen) == sorted((r.record_id, r.block) for r in records.collect())


def test_quality_classifier(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i not in (19, 20, 21, 22)), 0) for i in range(4, 23)] + [(5, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, labels, F.col("source"), F.col("lang"))
    assert got.count() == len(corpus()) and all(0 < r.posterior < 1 for r in got.collect())
    kept = quality_classifier.accepted(docs, labels, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality_classifier.classify(none, labels, F.col("source"), F.col("lang")).count() == 0
    blank = quality_classifier.classify(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert {r.p_document for r in blank} == {0.5} and all(r.kept for r in blank)


def test_posteriors_by_hand(spark, docs):
    """Evidence, kappa, posteriors and verdicts of every document in plain numpy, from the fitted weights."""
    labels = spark.createDataFrame([(i, int(i not in (19, 20, 21, 22)), 0) for i in range(4, 23)], "doc_id long, quality int, toxic int")
    measured = docs.select(F.col("doc_id").alias("id"), quality_classifier.features(F.col("text")).alias("x"))
    model = quality_classifier.trained(measured, labels)
    rows = [(r.doc_id, r.source, r.lang, np.array(r.x)) for r in docs.select("doc_id", "source", "lang", quality_classifier.features(F.col("text")).alias("x")).collect()]
    z = np.array([np.clip(model.bias + sum((x - m) / s * w for x, m, s, w in zip(r[3], model.mean, model.scale, model.weights)), -12, 12) for r in rows])
    p = 1 / (1 + np.exp(-z))

    def kappa(sites):
        within = np.array([mu * (1 - mu) for _, _, mu in sites])
        spread = sum(n * (t / n - mu) ** 2 for n, t, mu in sites)
        between = (spread - within.sum()) / sum(n for n, _, _ in sites)
        return 1e6 if between <= within.mean() / 1e6 else max(1.0, within.mean() / between - 1)

    total = lambda key: {k: (sum(key(r) == k for r in rows), sum(x for r, x in zip(rows, p) if key(r) == k)) for k in {key(r) for r in rows}}
    hosts, paths, mu = total(lambda r: r[1]), total(lambda r: r[1:3]), p.mean()
    k = kappa([(n, t, mu) for n, t in hosts.values()])
    host = {h: (t + k * mu) / (n + k) for h, (n, t) in hosts.items()}
    k = kappa([(n, t, host[h]) for (h, _), (n, t) in paths.items()])
    path = {key: (t + k * host[key[0]]) / (n + k) for key, (n, t) in paths.items()}
    odds = lambda q: np.log(q / (1 - q))
    want = sorted(((r[0] or -1, p_, host[r[1]], path[r[1:3]], 1 / (1 + np.exp(-(z_ + odds(np.clip(path[r[1:3]], 1e-4, 1 - 1e-4)) - odds(model.base))))) for r, p_, z_ in zip(rows, p, z)))
    got = sorted((r.doc_id or -1, r.p_document, r.host_quality, r.path_quality, r.posterior) for r in quality_classifier.classify(docs, labels, F.col("source"), F.col("lang")).collect())
    assert np.allclose(np.array(got), np.array(want), atol=1e-9)


def test_fit_is_the_penalised_optimum():
    """The gradient of the penalised likelihood vanishes at the fitted weights."""
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((300, len(quality_classifier.FEATURES)))
    y = (x[:, 0] - x[:, 3] + rnd.standard_normal(300) > 0).astype(float)
    m = quality_classifier.fit(x, y)
    a = np.c_[(x - m.mean) / m.scale, np.ones(300)]
    w = np.array([*m.weights, m.bias])
    grad = a.T @ (y - 1 / (1 + np.exp(-a @ w))) - np.array([*[quality_classifier.RIDGE] * len(m.weights), 1e-6]) * w
    assert np.abs(grad).max() < 1e-5


def test_threshold_itself_is_kept(spark):
    """Ties at the threshold: without labels all evidence is 1/2, which stays at 0.5 and goes above it. Clashing columns keep their values."""
    df = spark.createDataFrame([(1, "some text", "h", "p", "v", 7.0)], "doc_id long, text string, host string, path string, x string, posterior double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judge = lambda t: quality_classifier.accepted(df, labels, F.col("host"), F.col("path"), threshold=t).collect()
    assert [tuple(r) for r in judge(0.5)] == [(1, "some text", "h", "p", "v", 7.0)] and judge(0.5 + 1e-9) == []


def test_sample_is_bounded(spark):
    measured = spark.range(4000).select("id", F.array(*[F.lit(float(k)) + F.col("id") % 7 for k in range(len(quality_classifier.FEATURES))]).alias("x"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    fit, quality_classifier.fit = quality_classifier.fit, lambda x, y: seen.append(len(y))
    try:
        quality_classifier.trained(measured, labels, 500)
        quality_classifier.trained(measured, labels, 5000)
    finally:
        quality_classifier.fit = fit
    assert 400 <= seen[0] <= 500 and seen[1] == 4000


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 500 + [("bad", "p", 0.1)] * 500 + [("one", "p", 0.1)]
    got = {r.host: r for r in quality_classifier.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got["big"].path_quality > 0.85 and got["bad"].path_quality < 0.15
    assert got["bad"].path_quality < got["one"].path_quality


def test_neighbours(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((400, 8))
    rows = [(k, v.tolist(), "e") for k, v in enumerate(x)]
    rows += [(1000 + k, x[0].tolist(), "e") for k in range(40)]  # equal vectors
    rows += [(2000, None, "e"), (2020, [0.0] * 8, "e"), (2040, [float("nan")] + [1.0] * 7, "e"), (2060, [1.0], "e"), (None, x[1].tolist(), "e"), (2080, [None] + [1.0] * 7, "e"), (3, x[3].tolist(), "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(3)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    pool = {r[0]: np.array(r[1]) for r in rows if r[0] is not None and r[0] < 2000}
    assert sorted(got) == sorted(k for k in pool if k % 20 == 0)
    hits = 0
    for q, found in got.items():
        want = sorted((-float(pool[q] @ v), k) for k, v in pool.items() if k != q)[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(f[2] - float(pool[q] @ pool[f[1]])) < 1e-12 for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({f[1] for f in found} & {k for _, k in want})
    assert hits >= 0.9 * 20 * len(got)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    deep = Counter()  # partitions within partitions
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, parts=2, leaf=16, split=20, sample=200).collect():
        deep[r.query_id] += r.vec_id in [f[1] for f in got[r.query_id]]
    assert sorted(deep) == sorted(got) and sum(deep.values()) >= 0.8 * 20 * len(got)
    few = neighbours.nearest(df.where("vec_id < 7"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4, 5, 6]


def test_recall_on_the_registered_table(spark):
    """All vectors and queries of the table, against brute force."""
    got = neighbours.op3_neighbours(spark, "/root/testdata/sf0.01").toPandas()
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), np.float64)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[: min(20, len(ids) - 1)]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert len(own) == len(best) and np.allclose(own.score, x[np.searchsorted(ids, own.vec_id)] @ x[q], atol=1e-12)
        hits, total = hits + len(set(own.vec_id) & set(ids[best])), total + len(best)
    assert hits >= 0.9 * total
