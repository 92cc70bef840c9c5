"""Each operator against a brute-force version, on a small table with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, common, components, fingerprint, htmltext, langid, neardup, packing, pii, quality, tokenbin, tokens, warc
from quarry.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, label string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def corpus():
    r = random.Random(5)
    words = ["the", "Der", "été", "año", "straße", "und", "is", "a", "naïve", "thing", "x1", "42", "don't", "日本", "🙂"]
    rows = []
    for i in range(60):
        text = " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(r.randrange(3, 120)))
        rows.append((i, text, r.choice(["en", "de", None])))
    base = " ".join(f"w{i}" for i in range(100))
    rows += [(100 + i, base.replace(f"w{7 * i} ", f"q{i} "), "en") for i in range(8)]
    rows += [(200, None, "en"), (201, "", None), (202, "   \n\t ", "de"), (203, "one", "en"), (204, "two words", "en"), (205, "!!! 123 ???", "en")]
    rows += [(206, "y" * 5000, "en"), (207, "long " * 60_000, "en"), (None, "no id here at all", None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]
    return [(a, b, c, "s", None, "clash", "clash", "clash") for a, b, c in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_in_pieces():
    text = (b"alpha beta  gamma\n" * 200_000)[: 3 << 20]
    whole = common._hash_piece(text)[0]
    got, offs = common.word_hashes([text, b"", b"alpha"], lower=False)
    assert np.array_equal(got[: offs[1]], whole) and offs[2] == offs[1] and got[-1] == whole[0]


def test_fingerprint(spark, docs, none):
    rows = sorted(((d, t or "") for d, t, *_ in corpus()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want = Counter()
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        m = len(t) // 4
        want[(d, len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest())] += 1
    got = fingerprint.with_next(spark, docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t.translate(LOW))] for i in range(max(1, len(w) - 4)) if w}
    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
    exact, close = defaultdict(list), defaultdict(list)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        m = len(t) // 4
        own, edited, next_ = shingles(t), shingles(t[: len(t) - m] + after[:m]), shingles(after)
        for other, which in ((edited, "near_edited"), (next_, "near_next")):
            (exact if len(own | other) <= fingerprint.K else close)[d, which].append(like(own, other))
    assert len(exact) > 60
    for which in ("near_edited", "near_next"):
        for d in {r.doc_id for r in got}:
            have = sorted(getattr(r, which) for r in got if r.doc_id == d)
            want_ = sorted(exact[d, which] + close[d, which])
            assert have == pytest.approx(want_, abs=1e-9 if not close[d, which] else 0.15)
    one = {r.fingerprint for r in got if r.doc_id == 3}
    assert len(one) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.with_next(spark, none).count() == 0
    single = fingerprint.with_next(spark, docs.where("doc_id = 100")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    words = [f"t{i}" for i in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    x, y, z = fingerprint.sketches([a.encode(), b.encode(), " ".join(words).encode()], k=512)
    assert np.array_equal(fingerprint.merge([x, y], 512), fingerprint.merge([z], 512))
    assert abs(fingerprint.resemblance(x, y, 512) - 1996 / 5996) < 0.08
    assert abs(fingerprint.distinct_count(z, 512) / 5996 - 1) < 0.15 and abs(fingerprint.containment(x, y, 512) - 0.5) < 0.12
    df = fingerprint.fingerprint(spark.createDataFrame([("k", a), ("k", b), (None, "a b c d e f")], "g string, text string"))
    got = {r.g: r.fingerprint for r in fingerprint.merge_by(df, "g").collect()}
    assert np.array_equal(fingerprint.from_text(got["k"]), fingerprint.merge(fingerprint.sketches([a.encode(), b.encode()])))


def test_byte_bpe(spark, docs, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t, *_ in corpus():
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        want[(d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = bpe.encode(spark, docs, path, P.PATTERN)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert bpe.encode(spark, none, path, P.PATTERN).count() == 0
    r = random.Random(7)
    long_ = [b"y" * 300, b"=" * 5000, " naïvetés".encode() * 40, bytes(range(256)), *[bytes(r.choice(b"abc -=") for _ in range(r.randrange(1, 200))) for _ in range(200)], *[bytes(r.randrange(97, 123) for _ in range(n)) for n in (65, 300, 900)]]
    df = spark.createDataFrame([(i, list(w)) for i, w in enumerate(long_)], "i int, w array<int>")
    table = bpe.Ranks(ranks)
    for row in df.select("i", bpe.fold_all(F.array("w"), table)[0].alias("ids")).collect():
        assert row.ids == enc._core_bpe.encode_single_piece(long_[row.i])


def test_bpe_ranks_out_of_order(spark):
    """Pieces that unite at a lower rank than their own."""
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {w: 256 + i for i, w in enumerate([b"aba", b"abab", b"bb", b"ab", b"ba", b"aab", b"bbb", b"abb", b"aa"])}

    def brute(w):
        parts = [w[i : i + 1] for i in range(len(w))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(8)
    words = [bytes(r.choice(b"ab") for _ in range(n)) for n in [*range(1, 64), *range(65, 180, 3)]]
    table = bpe.Ranks(ranks)
    for row in spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "i int, w array<int>").select("i", bpe.fold_all(F.array("w"), table)[0].alias("ids")).collect():
        assert row.ids == brute(words[row.i])


def test_quality(docs, none):
    def brute(t):
        ws = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        win = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        n = Counter(win)
        hit = {j for i, w in enumerate(win) if n[w] > 1 for j in range(i, i + 5)}
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)

    got = quality.judged(docs)
    rows = got.select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == len(corpus())
    for r in rows:
        b = brute(r.text)
        assert tuple(r)[2:7] == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r.base_failed and r.kept)
    cut = {r.rule: r for r in quality.ablation(got).collect()}
    assert cut["few_words"].n_failed == sum(brute(t)[0] < 10 for _, t, *_ in corpus()) and cut["few_words"].n_docs == len(corpus())
    assert quality.judged(none).count() == 0


def test_language(spark, docs, none):
    def text(lang, i):
        r = random.Random(f"{lang}{i}")
        words = {"en": "the and of to in that with from this have", "de": "der und die nicht ein ist auf für von zu", "fr": "le la et les des est que pour dans une"}[lang].split()
        return " ".join(r.choice(words) for _ in range(40))

    rows = [(i, text(lang, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "de"), (902, "x", None)], "doc_id long, text string, lang string").withColumn("held", langid.held_out())
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in df.collect())
    model = langid.fit(spark, df.where("NOT held"))
    got = {r.doc_id: r for r in langid.predict(df.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[900].lang_pred == got[901].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = langid.fit(spark, none)
    assert empty[0] == [] and {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_language_is_the_cosine(spark):
    """Against bundles made trigram by trigram."""
    texts = [(0, "the cat and the hat", "en"), (1, "die Katze und der Hut", "de"), (2, "le chat et le chapeau", "fr"), (3, "the Hut, et la Katze!", None), (4, "x", None), (5, "Ünïcödé ΑΣ ñ", "fr")]

    def brute(text):
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        low = " " + " ".join(low.split()) + " "
        v = np.zeros(langid.DIM)
        for a, b, c in zip(low, low[1:], low[2:], strict=False):
            v += np.roll(langid._letter(ord(a)), 2) * np.roll(langid._letter(ord(b)), 1) * langid._letter(ord(c))
        return v / np.linalg.norm(v)

    protos = {}
    for lang in ("de", "en", "fr"):
        v = sum(brute(t) for _, t, x in texts if x == lang)
        protos[lang] = v / np.linalg.norm(v)
    mean = sum(protos.values()) / 3
    protos = {k: (v - mean) / np.linalg.norm(v - mean) for k, v in protos.items()}
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, lang string, __lang string")
    got = langid.predict(df, langid.fit(spark, df))
    assert set(got.columns) == {*df.columns, "lang_pred", "score"}
    for r in got.collect():
        cos = {k: float(brute(r.text) @ v) for k, v in protos.items()}
        best = max(sorted(cos), key=cos.get)
        assert r.lang_pred == best and r.score == pytest.approx(max(0, min(1, cos[best])), abs=1e-5)


def test_language_of_null_ids_and_long_texts(spark):
    rows = [(None, f"the cat {i} and the hat in that", "en") for i in range(50)] + [(None, f"die Katze {i} und der Hut nicht", "de") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, _ = langid.fit(spark, df, sample=30)
    assert names == ["de", "en"]
    text = "aé ß, the cat. " * 90_000
    for size in (10, 1 << 10, 1 << 20):
        old, langid.PIECE = langid.PIECE, size
        try:
            part = text[:3000] if size == 10 else text
            got = dict(zip(*(x.tolist() for x in langid.trigrams(part)), strict=True))
        finally:
            langid.PIECE = old
        low = " " + " ".join("".join(c if c.isalpha() else " " for c in part.lower()).split()) + " "
        want = Counter((ord(a) << 42 | ord(b) << 21 | ord(c)) for a, b, c in zip(low, low[1:], low[2:], strict=False))
        assert got == want


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><aside>side</aside><div id="content"><h1>A &amp; B</h1><p>First   <b>bold</b>
    text that is long enough to matter, really.</p><p>Second one,<br>also long enough to matter here.<script>var a="</p>";</script><ul><li>one<li>two</ul></div>
    <section class="comments"><p>nice post, I liked it very very much indeed and write a long comment here</p></section><form><input>Name</form><footer>&copy; x</footer></body></html>"""
    want = "A & B\nFirst bold text that is long enough to matter, really.\nSecond one, also long enough to matter here.\none\ntwo"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain text"), (5, "u", "<p>cut <b>off"), (6, "u", "<div>" * 3000 + "deep"), (None, "u", "<script>x")]
    got = htmltext.extracted(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert by == {1: [want, want], 2: [""], 3: [""], 4: ["plain text"], 5: ["cut off"], 6: ["deep"], None: [""]}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_pieces_are_the_librarys(name):
    from tokenizers import Tokenizer

    r = random.Random(2)
    texts = ["", "<|endoftext|> a", "a <|startoftext|><|endoftext|>b <|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ", "é x́", "a  b\t\n c d　e", "it's I'M we'LL", "x" * 500, " ", *[t for _, t, *_ in corpus()[:60]]]
    texts += ["".join(r.choice("aAéßΣİ'\t \ńẞ1٣!?‍\x1c日 ½") for _ in range(50)) for _ in range(200)]
    for plain in (False, True):
        t = Tokenizer.from_file(P.path(name))
        if plain:
            t.encode_special_tokens = True
        assert encoder(P.path(name), plain)(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_latin_texts_are_split_as_arrays(name, monkeypatch):
    from tokenizers import Tokenizer

    r = random.Random(3)
    texts = ["", " ", "  ", "'", "'s", "'street 're're 'v 've'", "a'", "''s \"'s it's'll", "x" * 500, "a \n b\n\n  c \t", "12 345a", "\x00'\x00s", "A\xa0B \x85 c", "end'", "s", "ll", "Àß µÿ"]
    texts += ["".join(r.choice("aBsrevl'' \n\t1é.\xa0\x85\x1c\x00") for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["".join(map(chr, r.choices(range(256), k=60))) for _ in range(500)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
    by_pattern = []
    monkeypatch.setattr(tokens, "_is_narrow", lambda text: by_pattern.append(text) or True)
    for block in (tokens.BLOCK, 300):
        monkeypatch.setattr(tokens, "BLOCK", block)
        by_pattern.clear()
        assert tokens._encoder(P.path(name), False)(texts) == want
        assert by_pattern == [t for t in texts if len(t) > block]


def test_common_pieces_stay_known():
    made = []
    known = tokens.Known(lambda p: made.append(p) or p.encode(), 10)
    for i in range(500):
        assert known["common"] == b"common" and known[f"rare{i}"] == f"rare{i}".encode()
        assert len(known) <= 10 and len(known.before) <= 10
    assert made.count("common") == 1
    assert known["x" * 100] and "x" * 100 not in known


def test_packing(spark, docs, none):
    path = P.path("byte_bpe_50k.json")
    ids = {}
    for (d, t, *_), raw in zip(corpus(), encoder(path)([t or "" for _, t, *_ in corpus()]), strict=True):
        ids.setdefault(d, raw + np.array([2], "<u4").tobytes())
    rows = packing.pack(spark, packing.pieces(docs, path)).collect()
    assert sum(r.length for r in rows) == sum(len(ids[d]) // 4 for d, *_ in corpus())
    seqs = defaultdict(list)
    for r in rows:
        n = len(ids[r.doc_id]) // 4
        assert r.length == 1024 or (r.piece == 0 and r.length == (n - 1) % 1024 + 1)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert packing.pack(spark, packing.pieces(none, path)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"documents": 3}, {"attention": 300_000, "score": "norm"}, {"documents": 2, "score": "norm"}])
def test_packing_plan_is_sequential_best_fit(limits):
    r = random.Random(3)
    sizes = Counter(r.choice([r.randrange(1, 500), 100, 37]) for _ in range(400))
    caps = (1024, limits.get("documents") or 1024, limits.get("attention") or 1024**2)
    seqs = defaultdict(list)
    seen = Counter()
    for n, a, z, s, o in packing.plan(dict(sizes), **limits):
        seen[n] += z - a
        for k in range(z - a):
            seqs[s + k].append((o, n))
    assert seen == sizes
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        assert sum(n for _, n in parts) <= caps[0] and len(parts) <= caps[1] and sum(n * n for _, n in parts) <= caps[2]
    assert Counter(tuple(sorted(n for _, n in parts)) for parts in seqs.values()) == Counter(tuple(sorted(x)) for x in brute_best_fit(sizes, caps, limits.get("score", "dot")))


def brute_best_fit(sizes, caps, score):
    """One piece after the other, by falling length."""
    weights, open_ = (1.0, 1e-3, 1e-3), []
    for n in sorted(sizes.elements(), reverse=True):
        use, best = (n, 1, n * n), None
        for parts, room in open_:
            if all(r >= u for r, u in zip(room, use, strict=True)):
                share = [(r - u) / c for r, u, c in zip(room, use, caps, strict=True)]
                value = sum(w * (u / c) * s if score == "dot" else w * s * s for w, u, c, s in zip(weights, use, caps, share, strict=True))
                if best is None or value < best[0] - 1e-15:
                    best = value, parts, room
        if best is None:
            best = 0, [], list(caps)
            open_.append(best[1:])
        best[1].append(n)
        best[2][:] = [r - u for r, u in zip(best[2], use, strict=True)]
    return [parts for parts, _ in open_]


def test_packing_capacities_act(spark, docs):
    path = P.path("byte_bpe_50k.json")
    for limits in ({"documents": 2}, {"attention": 1024**2 // 2, "tokens": 700}):
        seqs = defaultdict(list)
        for r in packing.pack(spark, packing.pieces(docs, path, limits.get("tokens", 1024)), **limits).collect():
            seqs[r.sequence_id].append(r.length)
        assert max(map(len, seqs.values())) <= limits.get("documents", 1024) and max(sum(n * n for n in x) for x in seqs.values()) <= limits.get("attention", 1024**2)
        assert sum(map(sum, seqs.values())) == packing.pieces(docs, path).agg(F.sum("length")).first()[0]


def brute_groups(rows, words, percent):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t, *_ in rows:
        ws = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(ws[j : j + words]) for j in range(len(ws) - words + 1)} or ({tuple(ws)} if ws else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, none, words, percent):
    want = brute_groups([r for r in corpus() if r[0] is not None], words, percent)
    rows = neardup.groups(spark, docs, words, percent).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert neardup.groups(spark, none, words, percent).count() == 0


def test_links_in_blocks_lose_none(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 500)
    base = [f"w{i}" for i in range(60)]
    r = random.Random(4)
    rows = []
    for i in range(80):
        ws = list(base)
        for _ in range(r.randrange(4)):
            ws[r.randrange(60)] = f"e{i}{r.random()}"
        rows.append((i, " ".join(ws)))
    got = {x.doc_id: x.component_id for x in neardup.groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 3, 85).items()}


def test_large_clusters_lose_no_link(spark, monkeypatch):
    """Chains of near copies around several hubs, in many blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 300)
    r = random.Random(9)
    rows, n = [], 0
    for _ in range(3):
        ws = [f"w{i}" for i in range(50)]
        for _ in range(40):
            if r.random() < 0.6:
                ws[r.randrange(50)] = f"v{r.randrange(10**6)}"
            rows.append((n, " ".join(ws)))
            n += 1
    for percent, words in ((85, 3), (70, 2)):
        got = {x.doc_id: x.component_id for x in neardup.groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()}
        assert got == {i: c for i, (_, c) in brute_groups(rows, words, percent).items()}


def test_signatures_of_many_places_and_chunks(monkeypatch):
    r = np.random.default_rng(2)
    vals = np.sort(r.integers(1, 2**63, 5000, dtype=np.uint64))
    doc = np.repeat([0, 1, 2], [10, 4000, 990])
    a = neardup.signatures(vals, doc, 3, 400)
    monkeypatch.setattr(neardup, "CHUNK", 700)
    assert np.array_equal(a, neardup.signatures(vals, doc, 3, 400))
    bands = neardup.band_hashes(a)
    assert not (bands[0] == bands[1]).any()


def test_superminhash_estimates():
    r = np.random.default_rng(1)
    pool = r.integers(1, 2**63, 900, dtype=np.uint64)
    a, b = np.sort(pool[:600]), np.sort(pool[300:])
    s = neardup.signatures(np.concatenate([a, b]), np.repeat([0, 1], 600), 2, 200)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.1


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.id: r.label for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[1000 + i] for i in range(30)}) == 1 and got[0] != got[1000]
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_pii(spark, docs, none):
    text = "mail bo.b@mail.example.com and BO.B@mail.example.com, 10.1.200.3, +1 (988) 555-2485, 4041894974608795, 4041-8949-7460-8795 on 1987-03-14 or 3.4.1999; 123-45-6789 DE89370400440532013000 token = \"0641917ea4e9\" end"
    made = pii.pseudonymized(spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "1234567890123456 and 1.5 or 2024-13-45")], "doc_id long, text string"), out="new", key="k").orderBy("doc_id").collect()
    assert made[0].new == made[1].new and made[2].new is None and made[3].new == "" and made[4].new == made[4].text
    assert made[0].pii_kinds == ["email", "email", "ip", "phone", "card", "card", "date", "date", "ssn", "iban", "secret"]
    for secret in ("bo.b", "10.1.200.3", "555-2485", "4041894974608795", "1987-03-14", "123-45-6789", "370400440532013000", "0641917ea4e9"):
        assert secret not in made[0].new
    cards = re.findall(r"\b[0-9]{16}\b|(?:[0-9]{4}-){3}[0-9]{4}", made[0].new)
    assert len(cards) == 2 and cards[0] == cards[1].replace("-", "")
    digits = [int(c) for c in cards[0]][::-1]
    assert sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2]) and (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
    iban = re.search(r"DE[0-9]{20}", made[0].new)[0]
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    plan = pii.pseudonymized(docs, key="k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.pseudonymized(docs, key="k").count() == len(corpus()) and pii.pseudonymized(none, key="k").count() == 0


def test_pii_columns_and_key(spark):
    df = spark.createDataFrame([(1, "mail a@b.example.com", "kept")], "doc_id long, text string, __new string")
    row = pii.pseudonymized(df, key="k").first()
    assert row["__new"] == "kept" and row.pii_kinds == ["email"]
    assert pii.pseudonymized(df, key="other").first().text != row.text
    with pytest.raises(ValueError, match="quarry.pii.key"):
        pii.pseudonymized(df)
    spark.conf.set("quarry.pii.key", "k")
    try:
        assert pii.pseudonymized(df).first().text == row.text
    finally:
        spark.conf.unset("quarry.pii.key")


def test_pii_values_map_one_to_one(spark):
    """Many values of each kind: no two share a pseudonym, and each one is a value of its kind."""
    r = random.Random(11)

    def luhn(body):
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    import datetime

    days = [datetime.date(1960, 1, 1) + datetime.timedelta(k) for k in range(0, 9000, 9)]
    values = {
        "card": {luhn("4" + f"{r.randrange(10**14):014d}") for _ in range(300)},
        "ip": {".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(300)},
        "ssn": {f"{r.choice([1, 665, 667, 899, *range(2, 600)]):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}" for _ in range(300)},
        "date": {d.isoformat() for d in days} | {d.strftime("%d.%m.%Y") for d in days} | {d.strftime("%m/%d/%Y") for d in days},
        "phone": {f"({r.randrange(200, 1000)}) {r.randrange(200, 1000)}-{r.randrange(10000):04d}" for _ in range(300)},
    }
    forms = {"card": r"\d{15}\d", "ip": r"(\d{1,3}\.){3}\d{1,3}", "ssn": r"\d{3}-\d{2}-\d{4}", "date": r"\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}", "phone": r"\(\d{3}\) \d{3}-\d{4}"}
    rows = [(k, v) for k, vs in values.items() for v in sorted(vs)]
    got = pii.pseudonymized(spark.createDataFrame(rows, "kind string, text string").repartition(4), out="new", key="k").collect()
    for kind in values:
        mine = [x for x in got if x.kind == kind]
        assert all(x.pii_kinds == [kind] and re.fullmatch(forms[kind], x.new) for x in mine)
        assert len({x.new for x in mine}) == len({x.text for x in mine})


def test_texts_over_a_mebibyte(spark):
    """One long text through every operator that cuts texts up."""
    r = random.Random(12)
    words = [f"wörd{r.randrange(10**5)}" for _ in range(200_000)]
    text = " ".join(words)
    assert len(text.encode()) > 2 << 20
    df = spark.createDataFrame([(1, text, "en"), (2, text + " end", "en")], "doc_id long, text string, lang string")
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (words, [*words, "end"])]
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in neardup.groups(spark, df, 3, 85).collect()} == {(1, len(sets[0]), 1), (2, len(sets[1]), 1)}
    one = fingerprint.with_next(spark, df).orderBy("doc_id").collect()
    assert one[0].n_chars == len(text) and one[0].near_next > 0.9
    q = quality.judged(df).orderBy("row.doc_id").collect()
    assert q[0].n_words == 200_000 and q[0].word_chars == sum(map(len, words))
    assert langid.predict(df, langid.fit(spark, df)).where("lang_pred = 'en'").count() == 2
    for name, run in (("byte_bpe_50k.json", lambda p: packing.pieces(df, p).groupBy("doc_id").agg(F.sum("length").alias("n"))), ("word_bpe_49k.json", lambda p: tokenbin.round_trip(spark, df, p).selectExpr("doc_id", "n_tokens AS n"))):
        n = {x.doc_id: x.n for x in run(P.path(name)).collect()}
        assert n[1] == len(encoder(P.path(name))([text])[0]) // 4 + 1
    page = "<body><nav><a href=x>menu</a></nav><article>" + "".join(f"<p>{' '.join(words[k : k + 100])}</p>" for k in range(0, 200_000, 100)) + "</article></body>"
    assert htmltext.extract(page) == "\n".join(" ".join(words[k : k + 100]) for k in range(0, 200_000, 100))


def test_feistel_is_a_permutation(spark):
    df = spark.range(40).selectExpr("id div 8 as x", "id % 8 as y")
    got = df.select(pii.feistel(F.col("x"), F.col("y"), F.lit(5).cast("bigint"), F.lit(8).cast("bigint"), "t", "k").alias("s")).select("s.*").collect()
    assert len({(r.x, r.y) for r in got}) == 40 and all(0 <= r.x < 5 and 0 <= r.y < 8 for r in got)


def test_warc(spark):
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "u\r\nx", "é" * 50_000), (7, "u", None), (8, "u", ""), (None, "u", "same"), (4, "v", "twice"), (4, "v", "twice")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string")
    got = warc.round_trip(spark, df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for p, _, h in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(5, "response", None), (1, "revisit", 5), (3, "revisit", 5), (None, "revisit", 5), (2, "response", None), (8, "response", None), (7, "revisit", 8), (4, "response", None), (4, "revisit", 4)}
    assert {r.record_type for r in warc.round_trip(spark, df, least=10**9).collect()} == {"response"}
    assert warc.round_trip(spark, df.limit(0)).count() == 0
    one = warc.record(1, "u", b"payload", None, False)
    assert [r[-1] for r in warc.read_records(io.BytesIO(one * 2))] == [b"payload"] * 2
    with pytest.raises(ValueError, match="early"):
        list(warc.read_records(io.BytesIO(one[:-3])))
    broken = zlib.compressobj(wbits=31)
    data = zlib.decompress(one, 31).replace(b"payload\r\n", b"paYload\r\n")
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(broken.compress(data) + broken.flush())))


def test_simple8b():
    r = np.random.default_rng(1)
    for a in (r.integers(0, 49408, 5000), r.integers(0, 3, 1000), np.zeros(500, int), r.integers(0, 2**62, 300), np.array([2**64 - 1, 1, 2**60, 2**60 - 1, 0, 2**64 - 1], np.uint64), np.empty(0, int)):
        assert np.array_equal(tokenbin.unpack_words(tokenbin.pack_words(a)), np.asarray(a, np.uint64))


def test_token_files(spark, docs, none):
    path = P.path("word_bpe_49k.json")
    rows = sorted(((d, t or "") for d, t, *_ in corpus()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want, at = Counter(), 0
    for (d, _), raw in zip(rows, encoder(path)([t for _, t in rows]), strict=True):
        ids = raw + np.array([2], "<u4").tobytes()
        want[(d, at, len(ids) // 4, zlib.crc32(ids))] += 1
        at += len(ids) // 4
    assert Counter(tuple(r) for r in tokenbin.round_trip(spark, docs, path).collect()) == want
    assert tokenbin.round_trip(spark, none, path).count() == 0


def test_pii_beside_other_characters(spark):
    cards = ["4111 1111 1111 1111 12/27", "4111111111111111 123", "4111 1111 1111 1111 737.", "12 4111 1111 1111 1111", "3782 822463 10005 4111 1111 1111 1111", "555-234-5678 4111 1111 1111 1111", "4111 1111 1111 1111 12ab", "123-45-6789 4111-1111-1111-1111"]
    ibans = ["GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606 PAID", "GB82WEST12345698765432", "AT61 1904 3002 3457 3201 EUR 500"]
    rows = [*cards, *ibans, "at 2024-01-05T10:00:00Z", "GB82 WEST 1234 5698 7654 33", "1234 5678 9012 3456 789x", "7 " * 3000 + "4111 1111 1111 1111"]
    got = {r.text: r for r in pii.pseudonymized(spark.createDataFrame([(t,) for t in rows], "text string"), out="new", key="k").collect()}
    for t in cards:
        new = got[t].new
        assert "card" in got[t].pii_kinds and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", t)
        for value in ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "555-234-5678", "123-45-6789"):
            assert value not in new
    for t in ibans:
        new = got[t].new
        end = re.search(" PAID| EUR 500|$", t).start()
        a, b = t[:end].replace(" ", ""), new[:end].replace(" ", "")
        assert got[t].pii_kinds == ["iban"] and new[end:] == t[end:] and b[4:] != a[4:] and b[:2] == a[:2]
        assert int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1
    assert got[ibans[0]].new.replace(" ", "") == got[ibans[2]].new.replace(" ", "")
    assert got["at 2024-01-05T10:00:00Z"].pii_kinds == ["date"] and got["at 2024-01-05T10:00:00Z"].new.endswith("T10:00:00Z")
    assert got[rows[-3]].new == rows[-3] and "4111 1111 1111 1111" not in got[rows[-1]].new


def test_long_secrets(spark):
    r = random.Random(6)
    one = "".join(r.choice("abcXYZ019_-") for _ in range(20_000))
    rows = [f"token={v} end" for v in (one, one[:300], one[:300] + "q", one[:199])]
    new = [x.new for x in pii.pseudonymized(spark.createDataFrame(list(enumerate(rows)), "i int, text string"), out="new", key="k").orderBy("i").collect()]
    for a, b in zip(rows, new, strict=True):
        assert len(a) == len(b) and b.startswith("token=") and b.endswith(" end")
        assert not any(a[k : k + 12] in b for k in range(6, len(a) - 16, 5))
    assert len({b[6:206] for b in new[:3]}) == 3 and new[0][6:70] != new[0][70:134]


def test_html_density_decides():
    story = "".join(f"<p>{'The story goes on and on here. ' * 8}</p>" for _ in range(3))
    plain = "\n".join(["The story goes on and on here. " * 8] * 3).replace(" \n", "\n").strip()
    links = "<ul>" + "<li><a href=x>Some other story's headline</a></li>" * 20 + "</ul>"
    # the story in sibling articles, all of it
    assert htmltext.extract(f"<body><main><article>{story}</article><article>{story}</article></main></body>") == plain + "\n" + plain
    # a list of links in the main element beside the story stays out
    assert htmltext.extract(f"<body><main><div>{links}</div><div>{story}</div></main></body>") == plain
    # teasers that are links don't join the article
    assert htmltext.extract(f"<body><article>{story}</article><article><a href=x>Another headline</a></article></body>") == plain
    # a heading in the same article belongs to it; a paragraph with inline markup doesn't take its place
    page = f"<body><article><h1>Title</h1>{story}<p>{'Very <b>bold</b> words and <i>more</i> of them. ' * 12}</p></article></body>"
    assert htmltext.extract(page).startswith("Title\nThe story") and htmltext.extract(page).endswith("more of them.")
    assert htmltext.extract("<body><p>one\u2003two\u2028three</p></body>") == "one two three"


def test_html_names_of_wrappers():
    story = "<h1>Title</h1><p>" + "The story goes on and on. " * 10 + "</p><p>" + "And then it ends. " * 10 + "</p>"
    want = htmltext.extract(f"<body><div>{story}</div></body>")
    assert want.startswith("Title")
    for a, b in [("div class='content has-sidebar'", "div"), ("div class='content with-sidebar'", "div"), ("div class='wrap sidebar-right'", "div"), ("div class='page-content comments-open'", "div"), ("article class='post comments-open'", "article"), ("article class='tag-related-works'", "article"), ("form id=aspnetForm", "form")]:
        assert htmltext.extract(f"<body><{a}>{story}</{b}><div class='cookie-notice'>We use cookies</div></body>") == want
    assert htmltext.extract(f"<body><div>{story}</div><div class='comments'><p>{'nice post ' * 300}</p></div></body>") == want
