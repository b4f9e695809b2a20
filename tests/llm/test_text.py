"""Chat, HTML, mixing, LM, language, quality and token output on small cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format as C
from tessera.llm import html_extract as H
from tessera.llm import language_id as L
from tessera.llm import lm_score as M
from tessera.llm import mixing as X
from tessera.llm import quality_rules as Q
from tessera.llm import token_output as T


def test_chat_round_trip():
    r = random.Random(2)
    for _ in range(3000):
        turns = [("".join(r.choice("<|\\\np im_end|>") for _ in range(r.randint(0, 5))), "".join(r.choice(["<", "|", "\\", "<|im_end|>", "\n", "<|im_start|>", "x"]) for _ in range(r.randint(0, 8)))) for _ in range(r.randint(0, 3))]
        formatted = C.render(turns)
        assert [(a, b) for a, b, _, _ in C.parse(formatted)] == turns
        assert all(C.unescape(formatted[s:e]) == t for (_, t), (_, _, s, e) in zip(turns, C.parse(formatted)))


def test_chat_events_fold(spark):
    e = [
        (1, 0, "a", "message", "user", "hi"), (1, 1, "b", "message", "assistant", "he"), (1, 2, "b", "delta", None, "llo"), (1, 3, "a", "edit", None, "hi there"),
        (1, 4, "c", "delta", "assistant", "x"), (1, 5, "c", "delete", None, None), (1, 6, "b", "regenerate", None, "good"), (1, 7, "b", "delta", None, " day"),
        (2, 0, "a", "message", "user", None), (None, 0, "a", None, "user", "z"), (3, 0, "a", "delete", None, None), (4, 0, "a", "odd", "user", "<|im_end|>" * 5000),
    ]
    df = spark.createDataFrame(e, "conv_id long, seq long, message string, kind string, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert [(a, b) for a, b, _, _ in C.parse(out[1].formatted)] == [("user", "hi there"), ("assistant", "good day")]
    assert [out[1].formatted[s.start : s.end] for s in out[1].loss_spans] == ["good day"]
    assert out[3].n_turns == 0 and out[3].formatted == "" and out[None].n_turns == 1 and C.parse(out[4].formatted)[0][1] == "<|im_end|>" * 5000
    got = {r.conv_id: r for r in C.digests(C.format_chats(df)).collect()}
    import hashlib

    whole = {1: [("user", "hi there"), ("assistant", "good day")], 2: [("user", "")], 3: [], None: [("user", "z")], 4: [("user", "<|im_end|>" * 5000)]}
    for conv, turns in whole.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv])[1:5] == want
    assert got[2].loss_chars == 0 and got[1].loss_chars == 8 and C.format_chats(df.where("false")).count() == 0


def test_html_parsing_and_extraction(spark):
    page = H.Page("<p>a&amp;b<b>c</b>d<script>x</p></script><br>e<ul><li>f<li>g&nbsp;h</ul><!-- i --><textarea>j</textarea>")
    assert page.text([True] * len(page.parents)) == "a&bcd e f g h"
    rng, exact, found, wanted = np.random.default_rng(77), 0, 0, 0
    model = H.trained()
    for _ in range(60):
        p = H.Page(H.generated_page(rng), marks=True)
        got, want = p.text(H.decode(p, model.predict(p.features()))), p.text([x == 1 for x in p.labels])
        exact, found, wanted = exact + (got == want), found + len(got), wanted + len(want)
    assert exact >= 54 and abs(found - wanted) < 0.03 * wanted
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<"), (3, "u", "<a href='x>" + "<div>" * 3000), (4, "u", "<article><h1>T</h1><p>One two three, four.</p><p>More text of the article, here.</p></article><footer>&copy; x</footer>")]
    df = spark.createDataFrame([*rows, rows[4]], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = H.extract(df).collect()
    assert H.extract(df.where("false")).count() == 0
    assert len(out) == 6 and [r.text for r in out if r.page_id == 4] == ["T One two three, four. More text of the article, here."] * 2
    assert [r.text for r in out if r.page_id in (1, 2)] == ["", ""] and all(r.n_chars == len(r.text) for r in out)


def test_decoding_is_consistent():
    rng = np.random.default_rng(5)
    for _ in range(50):
        p = H.Page(H.generated_page(rng))
        main = H.decode(p, rng.standard_normal(len(p.parents)))
        cut = [False] * len(main)
        for k in range(1, len(main)):
            up = p.parents[k]
            cut[k] = cut[up] or (main[up] and not main[k])
            assert not (cut[k] and main[k])


def test_decoding_is_the_best_of_all_consistent_choices():
    """Against every choice of states down small trees."""
    import itertools

    rng = np.random.default_rng(6)
    pages = ["<div>aa<p>b</p><p>cc</p></div>", "<ul><li>a<li>bb</ul><p>c</p>", "<div><div>a<div>b</div></div>cc</div>", "x<section>y<p>z</p>w</section><p>v</p>"]
    for k in range(40):
        p = H.Page(pages[k % len(pages)])
        n = len(p.parents)
        own = np.zeros(n)
        for node, t in p.pieces:
            own[node] += len(t)
        logits = rng.standard_normal(n)
        gain = logits * (1 + np.log1p(own))
        best = -np.inf
        for states in itertools.product((0, 1, 2), repeat=n):
            if states[0] == 2 or any((a, b) in ((0, 2), (1, 0), (2, 0), (2, 1)) for a, b in ((states[p.parents[i]], states[i]) for i in range(1, n))):
                continue
            best = max(best, sum(g for g, s in zip(gain, states) if s == 1))
        assert sum(g for g, m in zip(gain, H.decode(p, logits)) if m) == pytest.approx(best)


def test_deep_pages_are_parsed_in_time():
    import time

    began = time.perf_counter()
    p = H.Page("<div>" * 16000 + "a<p>b</p><li>c" + "</div>" * 16000)
    assert len(p.parents) == 16003 and time.perf_counter() - began < 2


@pytest.fixture
def sources(spark):
    r = random.Random(9)
    rows = [(k, "w " * r.randint(1, 60), r.choice(["a", "b", "c", "d", None])) for k in range(1500)]
    return spark.createDataFrame([*rows, (5000, None, "a"), (5001, "", "e"), (None, "x y", "a"), rows[0]], "doc_id long, text string, source string").withColumns({"target": F.lit(1), "lam": F.lit("z")})


def test_mix_meets_targets(spark, sources):
    out = X.mix(sources)
    got = out.collect()
    assert len(got) == 1504 and all(0 <= r.taken <= 2 * r.size for r in got) and {r.size for r in got if r.doc_id in (5000, 5001)} == {0}
    size, goal = {}, {}
    for r in sources.collect():
        size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    full = set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[n] for n in full)
        goal = {n: 2 * size[n] if n in full else rest * weight[n] / sum(weight[m] for m in names if m not in full) for n in names}
        over = {n for n in names if n not in full and goal[n] > 2 * size[n]}
        if not over:
            break
        full |= over
    taken = {}
    by_id = {(r.doc_id, len((r.text or "").split())): r.source for r in sources.collect()}
    for r in got:
        s = by_id[r.doc_id, r.size]
        assert r.target == pytest.approx(goal[s]) and r.source_size == size[s]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, X.mix(sources.repartition(3)).collect()))
    rows = X.resampled(sources)
    assert rows.columns == sources.columns and rows.count() == sum(r.copies for r in got)
    assert X.mix(sources.where("false")).count() == 0


def test_mixing_is_the_entropy_balance(spark, sources):
    """Uncapped rates have a log in proportion to size, and expected words meet the target."""
    got = X.mix(sources).where("size > 0").toPandas()
    for _, x in got.groupby(["source_size", "target"]):
        assert (x.rate * x["size"]).sum() == pytest.approx(x.target.iloc[0], rel=1e-6)
        free = x[(x.rate < 1.999999)]
        if len(free) > 3:
            assert np.ptp(np.log(free.rate) / free["size"]) < 1e-9


def test_language_id(spark):
    r = random.Random(3)
    vocabulary = {"xx": ["the", "and", "ing", "thou", "with"], "yy": ["der", "und", "schön", "keit", "von"], "zz": ["los", "que", "ción", "para", "más"]}
    say = lambda lang, n: " ".join("".join(r.choice(vocabulary[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    train = spark.createDataFrame([(say(k, 60), k) for k in vocabulary for _ in range(40)] + [(None, "xx"), ("", "yy"), ("text", None)], "text string, lang string")
    known = L.learn(train)
    assert sorted(known) == ["xx", "yy", "zz"]
    rows = [(k * 100 + i, say(k2, 30)) for k, k2 in enumerate(vocabulary) for i in range(30)]
    odd = [(900, None), (901, ""), (902, "12 34 !!"), (903, say("yy", 30000)), (None, say("xx", 20))]
    out = L.identify(spark.createDataFrame([*rows, *odd, rows[0]], "doc_id long, text string").withColumn("lang", F.lit("zz")), known).collect()
    by = {x.doc_id: x for x in out}
    assert len(out) == len(rows) + 6 and all(0 <= x.score <= 1 for x in out)
    assert np.mean([by[i].lang_pred == list(vocabulary)[i // 100] for i, _ in rows]) >= 0.98
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (900, 901, 902)) and by[903].lang_pred == "yy" and by[None].lang_pred == "xx"
    assert L.identify(spark.createDataFrame(rows[:2], "doc_id long, text string"), {}).first().lang_pred == "und"


def test_language_of_very_long_texts():
    """All of a text counts, not its first MiB, and the lead keeps pace with the length."""
    r = random.Random(8)
    letters = {"xx": "abcdeilmnorst", "yy": "ghijkuvwzaeon"}
    lexicon = {k: ["".join(r.choice(c) for _ in range(r.randint(3, 9))) for _ in range(20_000)] for k, c in letters.items()}
    say = lambda lang, n: " ".join(r.choices(lexicon[lang], k=n)).encode()
    sizes = L.sizes_by({k: [say(k, 7000) for _ in range(3)] for k in lexicon})
    assert sizes(say("xx", 250_000) + b" " + say("yy", 400_000)).argmin() == 1
    lead = [(n[1] - n[0]) / n[0] for n in (sizes(say("xx", k)) for k in (9_000, 500_000))]
    assert lead[1] > 0.8 * lead[0] > 0.002


def test_compiled_rules_are_the_learnt_ones(spark):
    """Scores of the compiled columns against the rules held in numpy."""
    r = random.Random(14)
    rows = [(k, " ".join(r.choice(["alpha", "Beta,", "x!", "12", "delta."]) * r.randint(1, 3) for _ in range(r.randint(0, 60))), k % 2) for k in range(300)]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "", None)], "doc_id long, text string, y int").withColumn("score", F.lit("clash"))
    measured = df.select("doc_id", *[c.alias(k) for k, c in Q.statistics(F.col("text")).items()], "y")
    rules, intercept = Q.train(measured, "y")
    got = {x.doc_id: x.score for x in Q.scored(measured, rules, intercept).collect()}
    for x in measured.collect():
        total = intercept
        for rule, weight in rules:
            total += weight * all(x[name] is not None and (x[name] > cut) == above for name, above, cut in rule)
        assert got[x.doc_id] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_quality_rules(spark):
    r = random.Random(4)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(r.randint(0, 99)) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(["spam!!"] * r.randint(10, 60)) for _ in range(150)]
    rows = [(k, t, int(k < 150)) for k, t in enumerate(good + bad)] + [(900, None, None), (901, "", None), (902, "a " * 30000, None)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, y int").select("doc_id", *[c.alias(k) for k, c in Q.statistics(F.col("text")).items()], "y")
    rules, intercept = Q.train(df, "y")
    assert 0 < len(rules) < 60
    out = Q.scored(df, rules, intercept).collect()
    assert len(out) == len(rows) + 1 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out)
    assert all(x.predicted == x.y for x in out if x.y is not None)
    assert Q.train(df.where("y = 1"), "y")[0] == [] and Q.train(df.where("false"), "y") == ([], 0.0)
    again = Q.train(df.repartition(3), "y")
    assert again == (rules, intercept)


def _lm(df):
    counts = M.word_counts(df)
    tokens = M.vocabulary(counts)
    return counts, tokens, M.encoded(df, tokens)


@pytest.mark.parametrize("counted", [200_000, 40])
def test_lm_score_is_the_plain_sum(spark, monkeypatch, counted):
    monkeypatch.setattr(M, "COUNTED", counted)
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(["red fox", "blue sky", "green tree", f"odd{r.randint(0, 9000)}"]) for _ in range(r.randint(1, 90)))) for k in range(400)]
    odd = [(900, None), (901, ""), (902, "red"), (None, "blue sky"), rows[0]]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string").withColumns({"n_tokens": F.lit(1), "h": F.lit("z"), "row": F.lit(2)})
    counts, tokens, base = _lm(df)
    assert len(tokens.known) == M.KNOWN and tokens.times[M.KNOWN :].max() > 1
    network = M.train(base, tokens, rounds=2)
    got = M.score(base, tokens, network, counts).collect()
    out = {x.doc_id: x for x in got}
    assert len(got) == len(rows) + 5 and sum(x.doc_id == 0 for x in got) == 2
    p, seen = network.p, {}
    for _, t in [*rows, *odd]:
        for w in (t or "").encode().split():
            seen[w] = seen.get(w, 0) + 1
    of_class = {}
    for w, n in seen.items():
        if w not in tokens.known:
            of_class[tokens.ending(w)] = of_class.get(tokens.ending(w), 0) + n
    for d, t in (rows[1], rows[2], rows[3], (902, "red")):
        found = t.encode().split()
        ids = [M.PAD] * M.SIDE + [tokens.known.get(w, tokens.ending(w)) for w in found] + [M.PAD] * M.SIDE
        total = 0.0
        for i in range(M.SIDE, len(ids) - M.SIDE):
            h = np.tanh(p["bias"] + sum(p["tables"][k][ids[i + o]] for k, o in enumerate(M._OFFSETS)))
            group, token = divmod(ids[i], M.EACH)
            a, b = h @ p["wc"] + p["bc"], h @ p["wt"][group] + p["bt"][group]
            total += a[group] - np.log(np.exp(a).sum()) + b[token] - np.log(np.exp(b).sum())
            w = found[i - M.SIDE]
            if w not in tokens.known:  # its share among the words of its ending
                total += np.log(seen[w] / of_class[tokens.ending(w)])
        assert out[d].log_prob == pytest.approx(total, rel=1e-4)
    assert out[900].n_tokens == 0 and out[901].log_prob == 0 and out[901].mean_log_prob is None
    assert M.lm_score(df.where("false")).count() == 0


def test_lm_gradients_are_those_of_the_score():
    """A training step's gradients against differences of the mean log-probability."""
    r = np.random.default_rng(3)
    flat, at = M.padded([r.integers(0, M.SIZE, 50).astype(np.int32)])
    network = M.Network(seed=1)
    for k in ("wc", "wt"):
        network.p[k] = r.standard_normal(network.p[k].shape).astype(np.float32) * 0.3
    taken = {}

    class Kept(M.Trainer):
        def _step(self, name, gradient, where=slice(None)):
            taken[name, where if isinstance(where, int) else None] = gradient

    Kept(network).batch(flat, at)
    for name, where, place in (("wc", None, (3, 5)), ("bc", None, (7,)), ("wt", None, (int(flat[at[0]]) // M.EACH, 2, 9)), ("tables", 1, (int(flat[at[4] - 1]), 6)), ("bias", None, (2,))):
        values = network.p[name] if where is None else network.p[name][where]
        kept, wide = values[place], []
        for step in (0.02, -0.02):
            values[place] = kept + step
            wide.append(-network.log_probs(flat, at).mean())
        values[place] = kept
        assert taken[name, where][place] == pytest.approx((wide[0] - wide[1]) / 0.04, rel=0.03, abs=1e-4)


def test_lm_beats_a_unigram_whatever_the_partitions(spark):
    """Documents of two invented languages: what stands around a word tells a good part of it, in held-out rows too."""
    r = random.Random(12)
    lexicon = [["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(3000)] for letters in ("abcdefghij", "klmnopqrst")]
    weights = [1 / (k + 3) for k in range(3000)]
    rows = [(k, " ".join(r.choices(lexicon[k % 2], weights, k=r.randint(20, 200)))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train, held = df.where("doc_id % 10 <> 0"), df.where("doc_id % 10 = 0")
    scores = []
    for parts in (1, 64):
        counts, tokens, base = _lm(train.repartition(parts))
        network = M.train(base, tokens, shard=100_000, batch=512)
        unigram = M.Network(tokens.times)
        got, plain = ({x.doc_id: x for x in M.score(M.encoded(held, tokens), tokens, n, counts).collect()} for n in (network, unigram))
        assert sum(x.log_prob for x in got.values()) / sum(x.n_tokens for x in got.values()) > sum(x.log_prob for x in plain.values()) / sum(x.n_tokens for x in plain.values()) + 0.5
        scores.append([got[k].mean_log_prob for k in sorted(got)])
    ranks = [np.argsort(np.argsort(x)) for x in scores]
    assert np.corrcoef(*ranks)[0, 1] > 0.999


def test_simple8b_round_trip():
    for n in (0, 1, 59, 60, 61, 4096, 5000, 40000):
        for top in (1, 2, 300, 50000, 2**40, 2**64 - 1):
            v = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True)
            v[n // 2 : n // 2 + 200] = 0
            assert (T.decode(T.encode(v)) == v).all()
    v = np.arange(20000)
    assert (T.decode(T.encode(v), 1, 3) == v[4096 : 3 * 4096]).all()
    assert len(T.encode(np.zeros(60000, int))) < 60000 / 60 * 8 + 1000


def test_token_output(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    rows = [(k, "".join(r.choice([" ", "a", "the", "\n", "  ", "!", ".", "é", "12", "<|endoftext|>", "'s", " ", "漢字", "_"]) for _ in range(r.randint(0, 30)))) for k in range(-20, 300)]
    rows += [(1000, None), (1001, "word " * 30000), (1002, "x"), (1002, "x"), (None, "null id")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "h": F.lit("z")})
    got = sorted(T.token_output(df).collect(), key=lambda x: x.start)
    want, at = [], 0
    for d, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(x) for x in got] == want
    assert T.token_output(df.where("false")).count() == 0


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that is the same for all pieces the ids are still the library's."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(T._Encoder, "_hashes", lambda self, flat, starts, ends: np.full(len(starts), 77, np.uint64))
    encoded = T._Encoder(path)
    texts = ["the same words", "other words, longeroneswithoutaspaceinthemwhatever", "a b", "the same"]
    for _ in range(2):
        assert encoded.batch(texts) == [encoded.whole(t).astype("<u4").tobytes() for t in texts]


def test_sizes_score_and_rejection_of_languages_equal_brute_force(spark, monkeypatch):
    import zstandard

    r = random.Random(9)
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "abcyz"}
    make = lambda lang, n: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(2, 6))) for _ in range(n))
    known = L.learn(spark.createDataFrame([(make(k, 60), k) for k in letters for _ in range(30)], "text string, lang string"))
    assert sorted(known) == ["aa", "bb", "cc"] and all(len(d) == 2 and all(d) for d in known.values())
    monkeypatch.setattr(L, "PIECE", 300)  # several pieces a text
    params = zstandard.ZstdCompressionParameters(window_log=20, chain_log=17, hash_log=17, search_log=3, min_match=3, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)

    def size(text, lang):
        n = max(1, -(-len(text) // 300))
        whole = 0
        for content in known[lang]:
            for k in range(n):
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                whole += len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress(text[len(text) * k // n : len(text) * (k + 1) // n]))
        return whole / len(known[lang])

    texts = [make(r.choice(list(letters)), r.randint(1, 200)) for _ in range(40)] + [make("aa", 30) + " " + make("bb", 30), "a", "", None, "12 34", "É"]
    sizes = L.sizes_by(known)
    for t in texts[:42]:
        plain = L.normalised(t)
        assert list(sizes(plain)) == [size(plain, k) for k in sorted(known)]
    monkeypatch.undo()
    got = {x.k: x for x in L.identify(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), known).collect()}
    for k, t in enumerate(texts):
        plain = L.normalised(t)
        if not plain:
            assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
            continue
        n = {x: float(L.sizes_by(known)(plain)[i]) for i, x in enumerate(sorted(known))}
        best = min(n, key=lambda x: (n[x], x))
        second = sorted(n.values())[1]
        assert got[k].lang_pred == best and got[k].rejected == (second - n[best] <= 0.002 * n[best])
        assert got[k].score == pytest.approx(1 / sum(2.0 ** max(n[best] - v, -60) for v in n.values()))


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 3)
    rows = [(f"text number {k}", f"l{k % n}") for n in (3, 4) for k in range(12)]
    assert len(L.learn(spark.createDataFrame(rows[:12], "text string, lang string"))) == 3
    with pytest.raises(ValueError, match="more than 3 languages"):
        L.learn(spark.createDataFrame(rows[12:], "text string, lang string"))
