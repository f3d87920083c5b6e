"""The operators of the subpackage against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import time
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import bpe, chat, components, html, packing, registry, rules, simhash, subword, suffix, tiff

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts):
    """Rows with repeated ids, extra columns whose names clash with the operators' own, and nulls."""
    rows = [(i, t, "en", None, 7, "x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double").withColumns(
        {"fp": F.lit(1), "k1": F.lit("k"), "id": F.lit(2), "n": F.lit(3), "kept": F.lit("?"), "bucket": F.lit("b")}
    )


NASTY = [
    None, "", " \n\t", "one", "one", "a b c d", "word " * 3000, "Ünïcode ß 日本 " * 40, "x" * 5000, "line\nline\nother\nline", "</s>[INST] \\ [/INST]",
    "one two three one two three four", "\x00\x01 \x1c \x85  ", "The idiot said so. " * 5,
]


@pytest.fixture(scope="module")
def nasty(spark):
    return documents(spark, NASTY + ["one"])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_registered_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours = registry.QUERIES[name](spark, SF).toPandas()
    theirs = con.sql(registry.SQL[name]).df()
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(ours) == rows(theirs)


def test_operators_take_empty_tables(spark):
    none = documents(spark, ["x"]).limit(0)
    assert rules.quality_rules(none).count() == 0
    assert rules.ablation(rules.ledger(none), rules.STRICT).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert suffix.suffix_digest(none).count() == 0
    assert packing.pack(none).count() == 0
    assert bpe.bpe_digest(none).count() == 0
    assert tiff.media_digest(none).count() == 0
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert subword.toxicity(none, labels).count() == 0
    assert subword.quality(documents(spark, ["a"]), labels).first().score == pytest.approx(0.5)
    assert chat.read_back(chat.format_segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# 1 rules


def repeat_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)})


def test_rules_against_brute_force(nasty):
    for r, text in zip(nasty.transform(rules.quality_rules).orderBy("doc_id").collect(), NASTY + ["one"], strict=True):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        expected = len(words) if len(words) > 100 and len(set(words)) == 1 else repeat_words(words)
        assert r.n_repeat_words == expected
        assert r.base_failed == (len(words) < 50 or 100 * expected > 50 * len(words))
        assert not (r.kept and r.base_failed)


def test_policies_and_ablation_read_the_ledger_only(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = rules.ledger(documents(spark, [good, good + " " + "# " * 40, "short", "short ###", good.upper()]))
    kept = lambda p: [r.kept for r in rules.apply_policy(rows, p).orderBy("doc_id").collect()]
    assert kept(rules.BASE) == [True, True, False, False, True]
    assert kept(rules.STRICT) == [True, False, False, False, False]
    found = {r.rule: (r.n_failed, r.n_only) for r in rules.ablation(rows, rules.STRICT).collect()}
    assert found["many_symbols"][0] == 2 and found["too_few_words"] == (2, 1) and found["shouting"] == (1, 1)


# 2 and 7 classifiers


@pytest.mark.parametrize(("label", "run", "modulus", "fold", "cut"), [("toxic", subword.toxicity, 4, 2, 0.3), ("quality", subword.quality, 3, 1, 0.5)])
def test_held_out_accuracy(spark, label, run, modulus, fold, cut):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = run(docs, labels).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % modulus == fold)).all()
    assert rows.score.between(0, 1).all() and ((rows.score >= cut) == (rows.predicted == 1)).all()
    rank = held.score.rank().to_numpy()
    y = held[label].to_numpy() == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.9  # some labels of these small tables show nowhere in the text
    assert ((held.predicted == 1) == y).mean() > 0.93


def test_scores_of_odd_texts_are_defined_and_ids_are_no_inputs(spark, nasty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] * 2, "doc_id long, quality int, toxic int")
    rows = subword.toxicity(nasty, labels).collect()
    assert len(rows) == len(NASTY) + 1 and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id in (3, 4, len(NASTY))}
    assert len(same) == 1


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    y = np.array(y) == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize("seed", [2, 3, 4, 5])
def test_unseen_misspellings_share_grams(seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda *bad: " ".join(rng.choice(plain) for _ in range(40)) + (" " + rng.choice(bad) if bad else "")
    texts = [line() for _ in range(150)] + [line("worthless", "worthlesss", "wworthless") for _ in range(150)]
    model = subword.fit(texts, [0] * 150 + [1] * 150, {0: 1.0, 1: 1.0}, subword.TOXICITY)
    y = [0] * 100 + [1] * 100
    clean, seen, unseen = (model.score([line(*bad) for _ in range(100)]) for bad in ((), ("worthless", "worthlesss"), ("worthles", "vorthless", "worthl3ss")))
    assert auc(np.r_[clean, seen], y) >= 0.95 and auc(np.r_[clean, unseen], y) >= 0.9
    assert (clean >= 0.3).mean() <= 0.1


def plain_score(model, text):
    """The forward pass word by word, in Python's whole numbers."""
    c, mask, prime = model.config, (1 << 64) - 1, 0x9E3779B97F4A7C15
    words = (text.lower() if c.lower else text).split()
    if c.same:
        words = words[:1] + [subword.SAME if a == b else a for a, b in zip(words[1:], words, strict=False)]

    def bucket(x):
        return ((((x ^ (x >> 29)) * prime) & mask) >> 32) % c.buckets

    def value(word):
        codes = [ord(x) for x in f"<{word}>"]
        found = []
        for n in c.grams:
            for i in range(len(codes) - n + 1):
                h = codes[i]
                for x in codes[i + 1 : i + n]:
                    h = (h * 0x100000001B3 + x) & mask
                found.append(bucket((h * prime + n) & mask))
        whole = sum(((x + i * prime) & mask) * ((2 * i + prime) & mask) for i, x in enumerate(codes)) & mask
        found.append(bucket((whole * prime) & mask))
        return sum(model.table[b] for b in found) / len(found)

    values = [value(w) for w in words]
    size = min(len(values), c.passage or len(values))
    best = max((sum(values[i : i + size]) / size for i in range(len(values) - size + 1)), default=0.0) if size else 0.0
    return 1 / (1 + np.exp(-min(40, max(-40, (model.bias + best) * model.slope + model.offset))))


@pytest.mark.parametrize("config", [subword.TOXICITY, subword.QUALITY])
def test_scores_against_a_plain_forward_pass(config):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["idiot", "Prose", "ß", "日本語", "a", "word", "Word", "x" * 40]) for _ in range(rng.randint(0, 30)))
    texts = [line() for _ in range(60)]
    model = subword.fit(texts, [int("idiot" in t) for t in texts], {0: 1.0, 1: 1.0}, config)
    some = texts + [t or "" for t in NASTY]
    assert model.score(some) == pytest.approx([plain_score(model, t) for t in some])


# 3 packing


def padding(lengths, counts, cuts):
    return sum(c * (min(b for b in cuts if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(4)
    for _ in range(30):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        for k in (1, 2, 3, 4):
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths, min(k, len(lengths)) - 1))
            found = packing.optimal_boundaries(lengths, counts, k)
            assert len(found) <= k and found[-1] == lengths[-1] and padding(lengths, counts, found) == best


def test_boundaries_are_optimal_beyond_small_lengths():
    rng = random.Random(5)
    for _ in range(20):
        lengths = sorted(rng.sample(range(200_000), 120))
        counts = [rng.randint(1, 10**9) for _ in lengths]
        best = [n * sum(counts[: i + 1]) for i, n in enumerate(lengths)]
        for k in range(1, 7):
            found = packing.optimal_boundaries(lengths, counts, k)
            assert padding(lengths, counts, found) == best[-1] - sum(n * c for n, c in zip(lengths, counts, strict=True))
            best = [min([best[j]] + [best[i] + lengths[j] * sum(counts[i + 1 : j + 1]) for i in range(j)]) for j in range(len(lengths))]


def test_padded_batches(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randint(1, 9) for _ in range(rng.choice([0, 3, 5, 40, 90]))] or None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    packed = packing.pack(df, length=F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")), budget=200)
    seen = {}
    for b in packing.padded_batches(df, packed, "ids").collect():
        assert len(b.keys) * b.padded_length <= 200 and all(len(x) == b.padded_length for x in b.token_ids)
        seen |= {k: [t for t in x if t] for k, x in zip(b.keys, b.token_ids, strict=True)}
    assert seen == {i: x or [] for i, x in rows}


def test_packing_is_whole_and_within_budget(spark, nasty):
    for slices in (3, 20_000):
        rows = packing.pack(nasty, budget=64, slice_rows=slices).toPandas()
        assert sorted(rows.doc_id) == list(range(len(NASTY) + 1))
        assert (rows.n_tokens <= rows.padded_length).all()
        assert not rows.duplicated(["batch_id", "slot"]).any() and sorted(rows.batch_id.unique()) == list(range(rows.batch_id.nunique()))
        for _, b in rows.groupby("batch_id"):
            assert b.bucket.nunique() == 1 and (len(b) == 1 or len(b) * b.padded_length.iloc[0] <= 64)
            assert sorted(b.slot) == list(range(len(b)))
    sizes = rows.set_index("doc_id").n_tokens
    assert [sizes[i] for i in range(len(NASTY))] == [len(WORD.findall(t or "")) for t in NASTY]


# 4 BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_equals_the_library(spark, nasty, tokenizer):
    path, library = tokenizer
    rng = random.Random(6)
    pieces = ["a", "aa", "'s", " ", "the", "\n", "é", "é", "ΟΔΟΣ", "<|startoftext|>", "<|endoftext|>", "!!", "日本", "12", "Ᲊ", "\U0001fae9", "İ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [t or "" for t in NASTY]
    mine = bpe.WordBpe(path, known=50)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for r, text in zip(bpe.bpe_digest(nasty).orderBy("doc_id").collect(), NASTY + ["one"], strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_ids(nasty, path), path).filter("doc_id = 5").first()
    assert back.decoded == library.decode(back.token_ids, skip_special_tokens=False)


# 5 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
<div id="cookie-notice">We use cookies, and more cookies, and partners, and so on.</div><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="sidebar"><p>Side text, with commas, that is as long as a paragraph, or longer than it, really.</p></div>
<article><h1>Title &amp; more</h1><p><b>First   paragraph, with commas,<br>and a break.<p>Second &eacute;&#233; one, unclosed
<ul><li>item</li><li>item</li></ul><form>Name <input> <button>Go</button></form><div class="ad">Buy, buy, buy this, now, please.</div></article>
<section class="comments"><p>Nice article, I liked it, really, very much so.</p></section><footer>&copy; us</footer></body></html>"""


def test_html():
    assert html.extract(PAGE) == "Title & more\nFirst paragraph, with commas, and a break.\nSecond éé one, unclosed\nitem\nitem"
    assert html.extract("") == "" and html.extract("<p></p>") == "" and html.extract("plain text") == "plain text"
    assert html.extract("<article><p>cut off here, and then <a hre") == "cut off here, and then"
    assert html.extract("<p>a</p>" * 3) == "a\na\na"
    deep = "<div>" * 3000 + "<p>deep text, all the way down, as they say, but found</p>"
    assert html.extract(deep) == "deep text, all the way down, as they say, but found"


@pytest.mark.parametrize("page", [
    "<x " * 350_000, "<div>x" * 170_000, "<x a='" * 170_000, '<x a=">' * 150_000, "</x>" * 250_000, "<div>" * 100_000 + "</p>" * 100_000,
    "<b>" * 150_000 + "<h1>a" * 100_000, "<li><b>" * 140_000, "<option><ul>" + "<b>" * 100_000 + "<option />" * 70_000, "<!--" * 250_000, "<p>a" * 250_000,
    "<span>" * 90_000 + "<p>a</p>" * 60_000, "<div class=sidebar><article>" * 35_000,
])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.extract(page)
    assert time.process_time() - began < 12  # a megabyte; a quadratic scan takes hours


def test_wrappers_named_after_what_stands_beside_the_article():
    body = "<p>" + "Prose, with commas, and more of it, as articles have. " * 5 + "</p>"
    expected = ("Prose, with commas, and more of it, as articles have. " * 5).strip()
    assert html.extract(f"<div class='content-sidebar-wrap'><main>{body}</main><div class=sidebar><p>Side, text, here.</p></div></div>") == expected
    assert html.extract(f"<div class='layout no-sidebar'>{body}</div><div class=sidebar><p>Side, text, here.</p></div>") == expected
    assert html.extract(f"<div class=post>{body}</div><section class=comments><article>{body}</article></section>") == expected
    short = "A short section, with a comma or two, that stands beside a long one, and is prose all the same."
    assert short in html.extract(f"<div>{body * 6}</div><div><p>{short * 3}</p></div>")


def test_pages_keep_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, None, PAGE, "x"), (1, "u", None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    found = sorted((str(r.page_id), str(r.url), r.n_chars == len(r.text), len(r.text) > 0) for r in html.extract_pages(rows).collect())
    assert found == [("1", "None", True, True), ("1", "u", True, False), ("None", "u", True, False)]


# 6 SimHash


def brute_components(fps, radius):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [4096, 2])
def test_simhash_against_brute_force(spark, nasty, block):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randint(1, 3) for _ in range(120)] for _ in range(5)]
    texts = []
    for _ in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = "Changed"
        texts.append(" ".join(words))
    docs = documents(spark, texts + NASTY)
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts + NASTY)}
    groups = brute_components(fps, 4)
    rows = simhash.near_duplicates(docs, block=block).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", groups[i]) for i in fps}
    assert len(set(groups.values())) < len(groups)


def test_masks_cover_every_pair_within_the_radius():
    import itertools

    tables = simhash.masks(2, 16)
    for k in (1, 2):
        for places in itertools.combinations(range(16), k):
            assert any(not any(m >> p & 1 for p in places) for m in tables)
    rng = random.Random(1)
    for _ in range(3000):
        places = rng.sample(range(64), 4)
        assert any(not any((m & (1 << 64) - 1) >> p & 1 for p in places) for m in simhash.masks())


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (7, None)]
    rows = components.stars(spark.createDataFrame(edges, "u long, v long")).collect()
    found = {r.u: r.v for r in rows}
    assert found == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)}


# 8 chat


def test_chat_escapes_are_reversible_and_parse():
    t = chat.DEFAULT
    rng = random.Random(3)
    bits = [*t.controls(), "\\", "\n", "a", "[", "<", "]", "<<", "/INST]", "é"]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        escaped = t.escape(text)
        assert t.unescape(escaped) == text and not any(m in escaped for m in t.controls())
        role = rng.choice(["user", "assistant", "system", "", "tool", "</s>"])
        assert t.read("".join(s for s, _ in t.segments(role, text)) * 2) == [(role, text)] * 2


def test_state_machine(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, None, None), (None, 1, "user", "x")]
    segments = chat.format_segments(spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, loss string"))
    errors = {(r.conv_id, r.turn_index): r.error for r in segments.filter("error is not null").collect()}
    assert (1, 2) not in errors and errors[(2, 0)] == "unknown role after start" and errors[(2, 1)] == "assistant after start"
    assert errors[(2, 2)] == "assistant after assistant" and errors[(None, 0)] == "ends after user"
    back = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert back[2].n_turns == 3 and back[2].loss_chars == 2 and back[1].loss_sha256 == hashlib.sha256(b"a").hexdigest()
    assert back[1].turns_sha256 == hashlib.sha256(b"system\ns\nuser\nu\nassistant\na\n").hexdigest()


# 9 suffix sort


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for t in raw:
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "frequent"), [(suffix.GROUP, 2048), (suffix.GROUP, 1), (2, 1), (5, 20)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, group, frequent):
    monkeypatch.setattr(suffix, "FREQUENT", frequent)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    base = [noise(700) for _ in range(5)]
    texts = list(NASTY)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 600)
            parts.append(rng.choice([rng.choice(base)[a : a + rng.randint(100, 420)], rng.choice(["a", "ab", "abc"]) * rng.randint(1, 150), "é" * rng.randint(1, 150), noise(rng.randint(1, 300))]))
        texts.append("".join(parts))
    texts += [texts[-1], texts[-1], "x" * 199, "y" * 200, "z" * 201]
    for size in (60, 130, 190, 199, 260):  # one passage in many texts
        common = noise(size)
        texts += [noise(rng.randint(0, 160)) + common + noise(rng.randint(0, 160)) for _ in range(15)]
    rows = suffix.suffix_dedup(documents(spark, texts), group=group).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").alias("spans"), F.sha2("kept", 256).alias("digest")
    )
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.spans, r.digest) for r in rows.collect()}
    assert [found[i] for i in range(len(texts))] == brute_removed(texts)


@pytest.mark.parametrize("group", [suffix.GROUP, 2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_that_repeat_under_one_id_are_separate_places(spark, group, seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    common = noise(60)
    texts = [noise(70) + common + noise(70) for _ in range(6)]
    texts += [noise(70) + common + noise(70) for _ in range(2)]
    rows = [(i, t) for i, t in enumerate(texts[:6])] * 2 + [(6 + i, t) for i, t in enumerate(texts[6:])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 14 and all(r.n_removed == (200 if r.doc_id < 6 else 0) for r in found)


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 100, (200, suffix.LENGTH)).astype(np.uint8)
    sizes = rng.integers(1, suffix.LENGTH + 1, 200)
    rows[np.arange(suffix.LENGTH) >= sizes[:, None]] = 0
    groups = np.sort(rng.integers(0, 5, 200))
    keys = [(g, r[:n].tobytes()) for g, r, n in zip(groups, rows, sizes, strict=True)]
    good = suffix.Sorted(rows, sizes, groups)
    assert [keys[i] for i in good.order] == sorted(keys)
    monkeypatch.setattr(suffix, "BYTES", np.ones(256, np.uint64))  # every prefix collides
    bad = suffix.Sorted(rows, sizes, groups)
    assert [keys[i] for i in bad.order] == sorted(keys) and (bad.common == good.common).all()


def test_whole_characters_stay_whole(spark):
    twin = "é" * 120
    rows = suffix.suffix_dedup(documents(spark, ["aé" + twin, "b" + twin, twin]), whole_characters=True)
    for r in rows.collect():
        assert r.kept.decode() in ("", "a", "b", "é", "aé", "bé")


# 10 TIFF


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 255, (37, 41, 3)).astype(np.uint8), np.zeros((90, 70, 1), np.uint8), rng.integers(0, 60000, (5, 7, 2)).astype(np.uint16)]
    for page, back in zip(pages, tiff.read_tiff(tiff.write_tiff(pages, compression, predictor, 8, tile, order)), strict=True):
        assert back.pixels == page.tobytes() and (back.height, back.width, back.samples) == page.shape and back.tiled == bool(tile)


def test_tiff_files_that_lie_about_their_size(spark):
    import struct

    def file(width, height, count=1, where=0):
        fields = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, count, where), (279, 4, 1, 5), (278, 4, 1, height)]
        return b"II" + struct.pack("<HIH", 42, 8, len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 0)

    bad = [file(1 << 30, 1 << 20), file(0, 5), file(5, 5, (1 << 32) - 1, 4), file(1 << 31, 1 << 31), b"II*\0", b"MM\0*\0\0\0\x08\xff\xff"]
    rows = tiff.decode_pages(spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "k int, media binary")).collect()
    assert sorted(r.k for r in rows) == list(range(len(bad))) and all(r.page_error for r in rows)


def test_tiff_walk_ends_on_cycles_and_reports_errors(spark):
    data = bytearray(tiff.write_tiff([np.zeros((2, 2, 1), np.uint8)], tiff.NONE, 1))
    count = int.from_bytes(data[8:10], "little")
    data[10 + 12 * count : 14 + 12 * count] = (8).to_bytes(4, "little")
    assert len(list(tiff.read_tiff(bytes(data)))) == 1
    rows = spark.createDataFrame([(1, bytes(data), 5), (2, b"junk", 5), (3, None, 5), (4, bytes(data[:30]), 5)], "doc_id long, media binary, width int")
    found = {r.doc_id: (r.width, r.page_error is None) for r in tiff.decode_pages(rows).collect()}
    assert found == {1: (2, True), 2: (None, False), 3: (None, False), 4: (None, False)}


def test_media_digest(spark, nasty):
    for r, text in zip(tiff.media_digest(nasty).orderBy("doc_id").collect(), NASTY + ["one"], strict=True):
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.feature and r.page_error is None


def test_unicode_tables_are_the_ones_the_splitter_expects():
    assert unicodedata.unidata_version >= "15"
