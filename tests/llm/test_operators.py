"""Operators of the llm subpackage against brute force, round trips and edge cases."""

import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from panelwright.llm import decontam, htmlblocks, htmlcrf, linequality, minhash, packing, qualitylr, rans, substring, tokens, toxicity, urltrie  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Null, empty, wordless, very short, repeated and long texts; null and repeated ids.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (6, "x " * 30000), (7, "é ü\u00a0ß 日本 a\n\na"), (8, "A b C d e f g")]


def lit_of(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", 0) for i, t in rows], DOCS)


def made_up(seed, n=60):
    """Documents that share passages, with copies and near copies."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passages = [[r.choice(vocabulary) for _ in range(r.choice((40, 60, 130)))] for _ in range(5)]
    texts: list[str] = []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(r.choice(texts))
        elif texts and kind < 0.4:
            words = r.choice(texts).split()
            for _ in range(r.randint(1, 6)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            words = []
            for _ in range(r.randint(0, 4)):
                words += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(1, 80))]
            texts.append(" ".join(words))
    return list(enumerate(texts))


# ------------------------------------------------------------ substring dedup


def brute_passages(rows, window):
    first = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("seed", "window"), [(1, 50), (2, 7), (3, 100), (4, 2), (5, 13)])
def test_passages_against_brute_force(spark, seed, window):
    rows = made_up(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(docs_of(spark, rows), window).collect()}
    assert got == brute_passages(rows, window)


def test_every_window_holds_an_extension_of_each_level():
    assert substring.doubling(50) == [13, 25, 50] and substring.doubling(7) == [2, 4, 7] and substring.doubling(100) == [13, 25, 50, 100]
    for window in range(2, 260):
        size, *between, last = substring.doubling(window)
        assert last == window and all(offset + n <= window or offset + size >= n for n in between for offset in range(window - size + 1))


def test_passages_where_all_texts_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(substring, "MOST_BROADCAST", 0)
    rows = made_up(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(docs_of(spark, rows), 50).collect()}
    assert got == brute_passages(rows, 50)


def test_passages_edges_and_layout(spark):
    out = substring.substring_dedup(docs_of(spark, EDGE).withColumnRenamed("lang", "kept"), 5, layout=True)
    assert out.columns == ["doc_id", "source", "n_chars", "n_words", "n_removed", "kept"]
    rows = out.collect()
    assert len(rows) == len(EDGE)
    assert sum(r.n_removed for r in rows if r.doc_id in (5, None)) == 0
    text = "One  two\nthree four"
    again = substring.substring_dedup(docs_of(spark, [(1, "two three"), (2, text)]), 2, layout=True).where("doc_id = 2").first()
    assert again.kept == "One four"
    assert substring.substring_dedup(docs_of(spark, []), 50).count() == 0


# ------------------------------------------------------------ near duplicates


def brute_components(rows, percent):
    def shingles(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_components_against_brute_force(spark, percent):
    rows = made_up(percent, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows), percent).collect()}
    assert got == brute_components(rows, percent)


@pytest.mark.parametrize(("split", "levels"), [(64, 8), (3, 8), (3, 2)])
def test_large_groups_of_edited_copies_against_brute_force(spark, monkeypatch, split, levels):
    """Copies of two related texts, each with many edits of its own, some of which recur: most are near the limit."""
    monkeypatch.setattr(minhash, "_SPLIT", split)
    monkeypatch.setattr(minhash, "_LEVELS", levels)
    r = random.Random(11)
    base = [f"b{k}" for k in range(90)]
    other = base[:50] + [f"c{k}" for k in range(40)]
    places = r.sample(range(90), 12)
    rows = []
    for i in range(260):
        words = list(r.choice((base, base, other)))
        for at in r.sample(places, r.randint(0, 5)) if r.random() < 0.5 else r.sample(range(90), r.randint(0, 5)):
            words[at] = r.choice(("x", "y", "z", f"u{i}"))
        rows.append((i, " ".join(words[: r.choice((90, 90, 90, 80, 70))])))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs_of(spark, rows), 80).collect()}
    assert got == brute_components(rows, 80)


def test_texts_that_share_an_id_are_compared_each(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (7, b), (9, b + " more"), (11, a + " more"), (12, "else")]
    got = sorted((x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(docs_of(spark, rows), 80).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (11, 5, False), (12, 12, True)]


def test_near_duplicate_edges(spark):
    rows = minhash.near_duplicates(docs_of(spark, EDGE), 85).collect()
    assert len(rows) == len(EDGE)
    by = {r.doc_id: r for r in rows}
    assert by[8].component_id == 5 and not by[8].kept and by[1].kept and by[1].n_shingles == 0 and by[None].kept
    assert minhash.near_duplicates(docs_of(spark, []), 85).count() == 0


def test_index_layout_meets_the_wanted_miss():
    for percent in (80, 85, 95):
        chunks, width, errors = minhash.index_layout(percent)
        s = percent / 100
        shared = s**width + width * s ** (width - 1) * (1 - s)
        assert errors == 1 and (1 - shared) ** chunks <= minhash.MISS


# ------------------------------------------------------------ decontamination


def brute_hits(rows, items, n=13):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for key, text in items:
        w = split(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(key)
    out = {}
    for i, text in rows:
        w = split(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                keys = windows.get(tuple(w[k : k + size]))
                if keys:
                    hit |= set(range(k, k + size))
                    found |= keys
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("shortest", [1, 3])
def test_hits_against_brute_force(spark, shortest, monkeypatch):
    r = random.Random(shortest)
    v = [f"t{k}" for k in range(25)]
    items = [(k, " ".join(r.choice(v) for _ in range(r.choice((shortest, 8, 13, 20, 30))))) for k in range(12)] + [(90, ""), (91, None)]
    rows = [(i, " ".join(x for _ in range(4) for x in ([r.choice(v) for _ in range(20)] if r.random() < 0.5 else (r.choice(items)[1] or "").upper().split())) + " End.") for i in range(40)]
    want = brute_hits(rows, items)
    for block, at_once in ((decontam.BLOCK_WORDS, decontam.PASS_WORDS), (decontam.BLOCK_WORDS, 20)):
        monkeypatch.setattr(decontam, "PASS_WORDS", at_once)
        got = decontam.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in got} == want


def test_blocks_of_a_pass_find_what_one_finds(monkeypatch):
    r = random.Random(6)
    v = [b"t%d" % k for k in range(9)]
    items = [(k, [r.choice(v) for _ in range(r.choice((2, 13, 30)))]) for k in range(20)]
    words = [r.choice(v) for _ in range(3000)] + items[3][1] + items[5][1]
    hits = {}
    for block in (decontam.BLOCK_WORDS, 50):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        found = [m.automaton.walk(words) for m in decontam.matchers(f"pass {block}", items, 4)]
        hits[block] = ({x for spans, _ in found for x in spans}, set().union(*[keys for _, keys in found]))
        assert len(found) == (1 if block > 50 else len(found)) and len(decontam._MATCHERS) == 1
    assert len(set(map(str, ({k: sorted(x) for k, x in enumerate(h)} for h in hits.values())))) == 1


def test_cut_removes_the_spans(spark):
    item = " ".join(f"q{k}" for k in range(15))
    rows = [(1, f"Before {item}, after. " + "x " * 900), (2, "nothing here"), (3, None)]
    out = {r.doc_id: r for r in decontam.decontaminate(docs_of(spark, rows).withColumnRenamed("lang", "items"), spark.createDataFrame([(7, item)], "item_id long, text string"), cut=True).collect()}
    assert out[1].n_hit == 15 and not out[1].contaminated and out[1].text.startswith("Before, after.") and out[2].text == "nothing here"
    assert out[3].n_words == 0
    mixed = f"A BCD eFg Hi. {item.upper()} Then MORE Of it, " + "Yes NO " * 300
    mixed = decontam.decontaminate(docs_of(spark, [(0, "ABC Def"), (4, mixed)]), spark.createDataFrame([(7, item)], "item_id long, text string"), cut=True).where("doc_id = 4").first()
    assert not mixed.contaminated and mixed.text == "A BCD eFg Hi Then MORE Of it, " + "Yes NO " * 300
    assert decontam.decontaminate(docs_of(spark, EDGE), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


# ------------------------------------------------------------ line quality


def test_lines_and_base_counts(spark):
    boiler = "Shared Line of the host"
    rows = [(i, f"{boiler}\nown text number {i} with enough words in it to pass all rules") for i in range(20)] + [(100, f"{boiler}\n {boiler.upper()}\nx y z a b"), (101, "a b c d e a b c d e"), (102, None), (103, "#$ a|b\n\na|b\na|b")]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in linequality.line_quality(docs, texts=True, depleted_percent=60).collect()}
    assert out[3].kept and out[3].n_line_words == 5 and out[3].text.startswith("own text number 3")
    assert out[100].n_line_words == 10 and not out[100].kept and out[100].text == "x y z a b"
    assert out[101].n_repeat_words == 10 and out[101].base_failed
    assert out[102].n_words == 0 and out[102].base_failed
    assert (out[103].n_symbols, out[103].n_dup_lines, out[103].word_chars) == (5, 1, 11)
    assert linequality.line_quality(docs_of(spark, EDGE)).count() == len(EDGE)
    assert linequality.line_quality(docs_of(spark, [])).count() == 0


# ------------------------------------------------------------ url filter


def test_urls_by_trie_and_by_join(spark, monkeypatch):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/x", "allow")]
    urls = [None, "no scheme", "http://a.com", "http://A.Com/x", "http://b.example.com/en/1", "http://www.example.com/en/?q", "https://x.net/es/", "https://x.net/es/xy", "https://net/es", "://notcom/", "a://com/#x"]
    want = {}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = host.lower()
        fit = [(len(h.split(".")), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        want[i] = (host, path, best[2], best[3])
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (urltrie.MOST_ENTRIES, 1):
        monkeypatch.setattr(urltrie, "MOST_ENTRIES", most)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urltrie.filter_urls(pages, table).collect()}
        assert got == want
    assert urltrie.filter_urls(pages.limit(0), table).count() == 0


# ------------------------------------------------------------ tokens, packing, files


TEXTS = ["", None, "Hello  world's\n\nTEST 123 ½", "İstanbul ΣΑΣ ﬁ", "<|endoftext|> x", "\x1cab\x1d", "cafe\u0301 É ñ", "日本語", "a\u00a0b\u0085c", "word " * 5000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_agrees_with_the_tokenizer(name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    got = tokens.Encoder(public_tokenizers.path(name)).encode(TEXTS)
    assert [list(x) for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_agrees_on_all_usual_characters(name, monkeypatch):
    """Each character alone and in words, then random strings with marks, added tokens and the pieces' memory emptied."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    r = random.Random(8)
    letters = [chr(c) for c in range(1, 0x250)] + [chr(c) for c in range(0x2010, 0x2028)] + ["\u20ac"]
    texts = [x for c in letters for x in (c, f"a{c}b", f"{c.upper()}HMED 1{c}", f" {c} {c}{c}\n")]
    far = "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ"
    parts = [*letters, *far, *[chr(c) for c in range(0x300, 0x310)], "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "'S", " ", " ", "\n\n", "the", "Word"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(40_000)]
    texts += ["".join(r.choice(letters + list(far)) for _ in range(r.randint(1, 25))) for _ in range(20_000)]
    monkeypatch.setattr(tokens, "MOST_PIECES", 20_000)
    encoder = tokens.Encoder(public_tokenizers.path(name))
    for a in range(0, len(texts), 1000):
        part = texts[a : a + 1000]
        wanted = [x.ids for x in whole.encode_batch(part, add_special_tokens=False)]
        assert [list(x) for x in encoder.encode(part)] == wanted


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_splits_contractions_and_white_space(name):
    """Strings of what the split patterns treat apart, many to a call, between texts that the tokenizer encodes itself."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    r = random.Random(12)
    parts = [*"'" * 5, *"strevlmdSTab12½-.\u2019 \n\t\xa0", "  ", "'re", "'ll", "'ve", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(30_000)]
    texts = [x for t in texts for x in ((t,) if r.random() < 0.98 else (t, None, t + "日", "\x1c" + t, "<|endoftext|>" + t))]
    encoder = tokens.Encoder(public_tokenizers.path(name))
    for a in range(0, len(texts), 3000):
        part = texts[a : a + 3000]
        assert [list(x) for x in encoder.encode(part)] == [x.ids for x in whole.encode_batch([t or "" for t in part], add_special_tokens=False)]
    only_far = ["日本", "\x1c"]
    assert [list(x) for x in encoder.encode(only_far)] == [x.ids for x in whole.encode_batch(only_far, add_special_tokens=False)]
    assert [list(x) for x in encoder.encode(["\n", None])] == [whole.encode("\n", add_special_tokens=False).ids, []]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_keeps_the_pieces_used_most(name, monkeypatch):
    """A full memory does not forget frequent pieces: the model encodes each of them once."""
    calls = []

    class Counted:
        def __init__(self, model):
            self.model = model

        def tokenize(self, piece):
            calls.append(piece)
            return self.model.tokenize(piece)

    monkeypatch.setattr(tokens, "MOST_PIECES", 100)
    encoder = tokens.Encoder(public_tokenizers.path(name))
    encoder.model = Counted(encoder.model)
    rare = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) + "qz" for n in range(2000)]
    got = [encoder.encode([" the" * 50 + "".join(f" {w}" for w in rare[a : a + 40])])[0] for a in range(0, 2000, 40)]
    assert sum(c.lstrip("\u0120") == "the" for c in calls) == 1 and len(calls) == 2001
    assert len(encoder.number) <= 140 and encoder.used <= len(encoder.pool)
    encoder.rest()
    assert len(encoder.number) <= 50 and list(encoder.encode([" the"])[0]) == encoder.tokenizer.encode(" the", add_special_tokens=False).ids and len(calls) == 2001
    for a, ids in zip(range(0, 2000, 40), got, strict=True):
        assert list(ids) == encoder.tokenizer.encode(" the" * 50 + "".join(f" {w}" for w in rare[a : a + 40]), add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark):
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(r.choice(("alpha", "beta", "gamma")) for _ in range(r.randint(0, 900)))) for i in range(60)]
    pieces = packing.pack(docs_of(spark, rows).repartition(3), public_tokenizers.path("byte_bpe_50k.json"), capacity=256, block_tokens=3000).collect()
    encode = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode
    sequences, docs = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 256 or at & (at - 1) == 0
    for i, text in rows:
        ids = np.append(encode([text])[0], 1)
        at = 0
        for start, length, crc, total in sorted(docs[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            at += length
        assert at == len(ids)
    assert packing.pack(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_balances_costs_better_than_filling_in_order():
    r = random.Random(7)
    lengths = [min(255, int(r.expovariate(1 / 60)) + 1) for _ in range(3000)]
    cost = lambda n: n + n * n / 2048
    placed, used = packing.pack_lengths(lengths, 256, 1.0, 1 / 2048)
    full = sum(lengths) // 256
    ours, covered = {}, [0] * len(lengths)
    for piece, start, take, sequence, _ in placed:
        assert start == covered[piece]
        covered[piece] += take
        ours[sequence] = ours.get(sequence, 0) + cost(take)
    assert covered == lengths and used == full + (sum(lengths) % 256).bit_count()
    # First fit: descending pieces to the first sequence with room, what fits nowhere is cut likewise.
    room, first = [256] * full + [1 << k for k in range(8, -1, -1) if sum(lengths) % 256 >> k & 1], {}
    queue, pieces = sorted(lengths, reverse=True), 0
    while queue:
        n = queue.pop(0)
        k = next((k for k, x in enumerate(room) if x >= n), None)
        if k is None:
            k = max(range(len(room)), key=room.__getitem__)
            queue = sorted([*queue, n - room[k]], reverse=True)
            n = room[k]
        room[k] -= n
        first[k] = first.get(k, 0) + cost(n)
        pieces += 1
    spread = [np.std([c for s, c in x.items() if s < full]) for x in (ours, first)]
    assert spread[0] < 0.95 * spread[1] and len(placed) <= 1.1 * pieces, (spread, len(placed), pieces)


@pytest.mark.parametrize("n", [1, 1023, 1024, 5000])
def test_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.4, n) % 3000
    table = rans.FrequencyTable.of_rows(rans.FrequencyTable(*np.unique(ids, return_counts=True)).rows())
    states, words = rans.encode_block(ids, table)
    assert (rans.decode_block(n, states, words, table) == ids).all()


def test_frequency_table_reads_ranks_off():
    ids = np.array([70_000, 5, 9, 5])
    table = rans.FrequencyTable.of_rows(rans.FrequencyTable(*np.unique(ids, return_counts=True)).rows())
    assert table.rank(ids).tolist() == [2, 0, 1, 0] and table.place.tolist()[:10] == [0] * 9 + [1]
    assert not len(rans.FrequencyTable.of_rows([]).rank(np.zeros(0, dtype=np.int64)))


def test_token_files_round_trip(spark):
    rows = [(i * 3 % 23, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (5, "same id"), (5, "same id")]
    folder = rans.token_folder(spark)
    rans.write_token_files(docs_of(spark, rows), public_tokenizers.path("word_bpe_49k.json"), folder)
    got = rans.read_token_files(spark, folder).collect()
    encode = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode
    want = sorted(((-1 if i is None else i), np.append(encode([t])[0], 2).astype("<u4").tobytes()) for i, t in rows)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    empty = rans.token_folder(spark)
    rans.write_token_files(docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json"), empty)
    assert rans.read_token_files(spark, empty).count() == 0


# ------------------------------------------------------------ classifiers


def test_quality_learns_and_scores_edges(spark):
    r = random.Random(1)
    good = [(i, " ".join(r.choice(("river", "stone", "light", "cloud", "paper")) + str(r.randint(1, 60)) for _ in range(40)).capitalize() + ".") for i in range(0, 200)]
    bad = [(i, " ".join([f"zz{i}"] * 30 + ["&&&"] * 5)) for i in range(200, 400)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, quality int")
    weights = qualitylr.train_quality(docs, labels, epochs=3)
    out = qualitylr.classify_quality(docs.withColumnRenamed("lang", "score"), weights).collect()
    held = [x for x in out if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    assert held and sum(x.predicted == int(x.doc_id < 200) for x in held) >= 0.97 * len(held)
    edge = qualitylr.classify_quality(docs_of(spark, EDGE), weights).collect()
    assert len(edge) == len(EDGE) and all(0 <= x.score <= 1 for x in edge)
    none = qualitylr.train_quality(docs, labels.limit(0))
    assert {x.score for x in qualitylr.classify_quality(docs, none).collect()} == {0.5}


def test_toxicity_learns_stems_and_sees_through_disguise(spark):
    r = random.Random(2)
    plain = lambda: [r.choice("abcdefgh") * r.randint(2, 5) + r.choice("xyz") for _ in range(40)]
    rows = []
    for i in range(600):
        words = plain()
        if i % 5 == 0:
            words[3], words[20] = r.choice(("moronic", "morons", "moron")), "vileness"
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs_of(spark, rows), labels)
    assert any("moronic".startswith(s) for s in model.lexicon), model.lexicon
    tests = [(1000, "you are a m0r0n and a м0rоn yes"), (1001, "a quiet day"), (1002, "ＭＯＲＯＮ mo\u200bron vileness"), *[(2000 + (i or 0), t) for i, t in EDGE]]
    out = {x.doc_id: x for x in toxicity.score_toxicity(docs_of(spark, tests), model).collect()}
    assert out[1000].predicted == 1 and out[1002].predicted == 1 and out[1001].predicted == 0 and out[2002].predicted == 0, (out, model)
    spared = toxicity.Model({"clown": 5.0}, ("clown fish",))
    assert spared.evidence("a Clown  fish".replace("  ", " "), spared.automaton())[0] == 0 and spared.evidence("a clown", spared.automaton())[0] == 5
    assert toxicity.train_toxicity(docs_of(spark, rows), labels.limit(0)).lexicon == {}


def test_evidence_against_a_naive_matcher():
    r = random.Random(3)
    model = toxicity.Model({"mor": 1.0, "moron": 2.5, "vile": 0.5, "clown": 4.0}, ("clown fish", "vile weed"))
    automaton = model.automaton()
    words = ["mor", "moron", "morons", "m0r0n", "MoRal", "vile", "vileness", "clown", "clown", "fish", "weed", "a", "x1", "-", "évil", "\u200bmo\u200bron"]
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice((" ", " ", "  ", ".", "\n")) for _ in range(r.randint(0, 12)))
        folded, n = toxicity.fold(text)
        spared = [(m.start(), m.end()) for p in model.exceptions for m in re.finditer(f"(?= {p} )", folded) for m in [re.compile(f" {p} ").match(folded, m.start())]]
        weight = 0.0
        for i in range(len(folded) - 1):
            if folded[i] == " ":
                fits = [s for s in model.lexicon if folded.startswith(s, i + 1) and not any(a <= i and i + 1 + len(s) <= b for a, b in spared)]
                weight += model.lexicon[max(fits, key=len)] if fits else 0.0
        assert model.evidence(text, automaton) == (pytest.approx(weight), len(folded.split())) and n == len(folded.split())


def test_the_first_test_of_entries_keeps_all_significant_ones(spark):
    r = random.Random(5)
    rows = [(a, a + r.choice((0, r.randint(0, 40)))) for a in [r.randint(3, 60) for _ in range(600)]]
    for p in (0.05, 0.11, 0.5, 0.8):
        kept = {(x.a, x.n) for x in spark.createDataFrame(rows, "a long, n long").where(toxicity.not_by_chance(p)).collect()}
        wanted = {(a, n) for a, n in rows if a > n * p and toxicity._tail(a, n, p) <= np.log(0.01)}
        assert wanted <= kept and len(kept) <= 1.5 * len(wanted) + 5


def test_learning_against_plain_updates():
    """Follow-the-regularised-leader updates of single numbers, over features counted word by word."""
    import pyarrow as pa

    from panelwright.llm.textwords import SPACE_WORDS, words_of

    texts = ["one two three One two", "two two two !!", "", "&& x &&", "Three words here. one"]
    y, bits, alpha, beta, l1, l2 = [1, 0, 1, 0, 1], 10, 0.5, 1.0, 0.05, 1.0
    examples = []
    for text in texts:
        (_, _, words), *_ = words_of(pa.array([text]), SPACE_WORDS)
        x = {1 << bits: 1.0}
        for slots, _ in qualitylr._features(words, bits):
            for s in slots.tolist():
                x[s] = x.get(s, 0.0) + 8.0 / len(slots)
        examples.append(x)
    z, n = [0.0] * ((1 << bits) + 1), [0.0] * ((1 << bits) + 1)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    rng = np.random.default_rng(5)
    for _ in range(3):
        for k in rng.permutation(len(texts)):
            w = {i: weight(i) for i in examples[k]}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in examples[k].items())))
            for i, v in examples[k].items():
                g = (p - y[k]) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    got = qualitylr.learn([(pa.array(texts), np.array(y))], bits, 3)
    assert got == pytest.approx([weight(i) for i in range(len(z))], abs=1e-5)
    (_, _, words), *_ = words_of(pa.array([" ".join(texts)]), SPACE_WORDS)
    line = got[-1] + sum(8.0 * got[slots].sum() / len(slots) for slots, _ in qualitylr._features(words, bits))
    assert qualitylr.score_words(words, got, bits)[0] == pytest.approx(1 / (1 + np.exp(-line)))


@pytest.mark.parametrize("toxic", [11, 16])
def test_toxicity_learns_whatever_the_share_of_toxic_rows(spark, toxic):
    r = random.Random(toxic)
    rows = []
    for i in range(1600):
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
        if i % 20 < toxic:
            words[3], words[20] = r.choice(("moronic", "morons", "moron")), "vileness"
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 20 < toxic)) for i in range(1600)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs_of(spark, rows), labels)
    assert any("vileness".startswith(s) for s in model.lexicon), model.lexicon
    out = toxicity.score_toxicity(docs_of(spark, rows), model).where("held_out").collect()
    assert {(int(x.doc_id % 20 < toxic), x.predicted) for x in out} == {(0, 0), (1, 1)}


# ------------------------------------------------------------ main text


PAGE = """<html><head><title>T</title><style>x</style></head><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Title &amp; more</h1><p>First   paragraph
of <b>text</b>, long enough to be one.<p>Second<br>one.<script>var a = "<p>no</p>";</script><div class="ad">Buy now</div><ul><li>Item one is here.</li></ul></article>
<section class="comments"><div class="comment"><p>Nice article, I liked it a lot.</p></div></section><aside><p>Related</p></aside><footer>&copy; 2020</footer>"""


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<<>><p"), (5, "u", "<p>" * 3000)], "page_id long, text string, html string")
    out = {r.page_id: r for r in htmlcrf.extract_main_text(pages).collect()}
    assert out[1].text == "Title & more\nFirst paragraph of text, long enough to be one.\nSecond one.\nItem one is here."
    assert out[1].n_chars == len(out[1].text) and out[2].text == "" and out[3].n_chars == 0
    assert htmlcrf.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["script", "SCRIPT", "svg", "SVG", "Math", "style"])
def test_skipped_elements_lose_no_page_text(name):
    page = f"<p>{'İ' * 30} a<{name}>x < y</{name}> rest of the paragraph, which is long enough</p><p>last</p>"
    assert " ".join(b.text for b in htmlblocks.blocks_of(page)) == f"{'İ' * 30} a rest of the paragraph, which is long enough last"


@pytest.mark.parametrize("page", ['<p>a</p><script src="x"/>var b;</script><p>c</p>', "<p>a</p><svg/><p>c</p>", "<p>a</p><div/><p>c</p>", "<p>a</p><SCRIPT />b <p>d</SCRIPT><p>c"])
def test_a_slash_closes_no_element_but_drawings(page):
    assert [b.text for b in htmlblocks.blocks_of(page)] == ["a", "c"]


def test_many_scripts_take_linear_time():
    import time

    page = "<p>x</p><script>var a = '<p>';</script>" * 16_000
    began = time.thread_time()
    assert len(htmlblocks.blocks_of(page)) == 16_000
    assert time.thread_time() - began < 3


@pytest.mark.parametrize("depth", [10, 1000, 100_000])
def test_deep_nesting_closes_no_outer_element(depth):
    page = "<div class=sidebar>" + "<div>" * depth + "<p>deep</p>" + "</div>" * depth + "<p>side</p></div></section><p>out</p>"
    features = [(b.text, "name=sidebar" in htmlcrf.path_features(b.path)) for b in htmlblocks.blocks_of(page)]
    assert features == [("deep", True), ("side", True), ("out", False)]
    below = htmlblocks.blocks_of("<div>" * depth + "<aside class=rail><p>x" + "</aside>y")
    assert [{"in=aside", "name=rail", "parent=aside"} <= set(htmlcrf.path_features(b.path)) for b in below] == [True, False]


def test_field_on_pages_it_has_not_seen():
    model = htmlcrf.standard_model()
    wrong = total = 0
    for page, labels in htmlblocks.labelled_pages(150, seed=77):
        found = model.decode(htmlblocks.blocks_of(page))
        wrong += sum(a != b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert wrong < 0.01 * total


def test_marginals_and_decoding_against_enumeration():
    from itertools import product
    from math import exp

    scores, pairs = [0.3, -0.7, 1.1, 0.2], [[0.5, -0.4], [0.1, 0.9]]
    weight = {y: exp(sum(s for s, v in zip(scores, y, strict=True) if v) + sum(pairs[a][b] for a, b in zip(y[:-1], y[1:], strict=True))) for y in product((0, 1), repeat=4)}
    total = sum(weight.values())
    ones, _ = htmlcrf.marginals(scores, pairs)
    assert ones == pytest.approx([sum(w for y, w in weight.items() if y[t]) / total for t in range(4)])
    model = htmlcrf.Model(pairs=pairs)
    model.emissions = lambda _: scores
    assert tuple(model.decode([])) == max(weight, key=weight.get)


# ------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "olo", "ire", "ute", "esk", "amp")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item = text(30)
    shared = text(70)
    rows = [(i, text(r.randint(60, 120))) for i in range(120)]
    rows += [(200 + i, " ".join([f"zz{i}"] * 60)) for i in range(60)]
    rows += [(300, rows[0][1]), (301, rows[1][1] + " extra"), (302, f"{text(40)} {shared} {text(40)}"), (303, f"{text(40)} {shared} {text(40)}"), (304, f"{text(50)} {item}")]
    docs = docs_of(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200)) for i, _ in rows if i < 300], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = []
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), DOCS)
        ids.append({x.doc_id for x in kept.collect()})
    assert not any(200 <= i < 300 for i in ids[0]) and set(range(120)) <= ids[0]
    assert 300 not in ids[1] and 301 not in ids[1] and {0, 1} <= ids[1]
    texts = {x.doc_id: x.text for x in kept.collect()}
    assert shared.rstrip(".") not in texts[303].capitalize() and len(texts[303].split()) == 80
    assert 304 in ids[2] and 304 not in ids[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == ids[3]


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    odd = docs_of(spark, EDGE).withColumns({"kept": lit_of("x"), "score": lit_of("y")})
    spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, "a b c"), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    quality, *rest = [stage for _, stage in corpus_pipeline.STAGES]
    for docs in (odd, odd.limit(0)):
        assert quality(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)
        kept = docs
        for stage in rest[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == list(corpus_pipeline.COLUMNS)
        pieces = rest[-1](spark, kept, str(tmp_path)).collect()
        ids = [p.doc_id for p in pieces if p.start == 0]
        assert sorted(ids, key=str) == ([] if docs is not odd else sorted([1, 2, 3, 4, 5, None, 6, 7], key=str))


def test_near_dedup_keeps_rows_without_id_and_one_of_equal_rows(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(0)), (None, text(0)), (None, None), (1, text(1)), (1, text(1)), (2, text(2)), (3, text(2)), (3, text(3)), (3, text(3)), (4, None), (4, None), (4, text(1)), (5, text(5))]
    out = corpus_pipeline.near_dedup(spark, docs_of(spark, rows), "")
    assert out.columns == docs_of(spark, []).columns
    wanted = [(None, text(0)), (None, text(0)), (None, None), (1, text(1)), (2, text(2)), (3, text(3)), (4, None), (5, text(5))]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(wanted, key=str)
