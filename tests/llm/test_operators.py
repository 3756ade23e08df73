"""Operators against brute force, on tables with nulls, ties, empty and long texts."""

from __future__ import annotations

import collections
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from steppe.llm import chat, components, jaccard, langid, media, packing, pieces, quality, sharding, urls, warc
from steppe.llm.queries import vocabulary

from .helpers import BASE, DOCS, LONG, NEAR, ROWS, documents, with_clashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(documents(spark)).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# chat


def test_escapes_are_reversible(spark):
    texts = ["", "plain", "<|im_end|>", "<\\|", "<\\\\|x", "\\n", "a\nb", "<<||>>", "\\<|im_start|>user\n", "<|<\\|<\\\\|"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape_role(F.col("t")).alias("er"))
    for r in out.collect():
        assert r["b"] == r["t"] and r["r"] == r["t"]
        assert "<|" not in r["e"] and "<|" not in r["er"] and "\n" not in r["er"]


def formatted_turns(done):
    return done.select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "again"), (1, 2, None, None),
        (None, 0, "assistant", "no id"), (2, None, "user", "x"), (2, None, "user", "x"), (3, 0, "assistant", ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("tree", F.lit("x"))
    out = {r["tree"]["conv_id"]: r for r in formatted_turns(chat.format_trees(chat.conversation_tree(frame))).collect()}
    assert set(out) == {1, 2, 3, None}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", "hi"), ("assistant", "<|im_end|>"), ("assistant", "again"), ("", "")]
    assert out[1]["learned"] == "<|im_end|>again" and out[None]["learned"] == "no id" and out[3]["learned"] == ""
    assert len(out[2]["turns"]) == 2
    empty = chat.format_trees(chat.conversation_tree(frame.limit(0)))
    assert empty.count() == 0


def test_trees_rank_branches_and_drop_cycles(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", "c", 0.0),
        ("t", 5, 99, "user", "orphan", 0.0), ("u", 1, 2, "user", "x", 0.0), ("u", 2, 1, "user", "y", 0.0), ("u", 3, 2, "user", "z", 0.0),
    ]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    everything = {(r["tree"], r["leaf"]): r for r in formatted_turns(chat.format_trees(m, branches=None)).collect()}
    assert set(everything) == {("t", 2), ("t", 4), ("t", 5)}
    assert [t["text"] for t in everything["t", 4]["turns"]] == ["q", "b", "c"]
    best = chat.format_trees(m, branches=1).collect()
    assert [(r["tree"], r["leaf"]) for r in best] == [("t", 4)]


def test_a_long_chain_takes_few_rounds(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = formatted_turns(chat.format_trees(chat.conversation_tree(frame))).collect()
    assert [t["text"] for t in r["turns"]] == [f"t{i}" for i in range(300)]
    assert r["learned"] == "".join(f"t{i}" for i in range(0, 300, 2))


# sharding


def test_shards_are_gapless_and_balanced(spark, docs, nothing):
    out = sharding.assign(docs, 4, 64).collect()
    assert len(out) == len(ROWS)
    for shard in {r["shard"] for r in out}:
        own = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert own == list(range(len(own)))
    sizes = collections.Counter((r["doc_id"], r["size"]) for r in out)
    assert sizes == collections.Counter((i, len((t or "").encode()) + 1) for i, t, _, _ in ROWS)
    assert all(r["text_crc32"] in {zlib.crc32((t or "").encode()) for _, t, _, _ in ROWS} for r in out)
    assert sharding.assign(nothing, 4, 64).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    loads = [r["b"] for r in sharding.assign(many, 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) <= 1.01 * min(loads)


def test_repeated_rows_are_balanced(spark):
    same = spark.range(0, 2000, 1, 7).select(F.lit(5).cast("long").alias("doc_id"), F.repeat(F.lit("y"), 50).alias("text"))
    null = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rest = spark.range(2000).select((F.col("id") + 100).alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"))
    out = sharding.assign(same.unionByName(rest).unionByName(null), 8).collect()
    loads = collections.Counter()
    for r in out:
        loads[r["shard"]] += r["size"]
    assert len(out) == 5000 and len(loads) == 8 and max(loads.values()) <= 1.01 * min(loads.values())
    for shard in loads:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


def test_a_stored_map_is_read_and_edited(spark):
    from steppe.llm.shared import scratch_path

    path = scratch_path(spark, "test-maps")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    one = {r["doc_id"]: r for r in sharding.assign(docs, 4, 256, path).collect()}
    assert {r["map_version"] for r in one.values()} == {0}
    more = docs.unionByName(docs.select((F.col("doc_id") + 3000).alias("doc_id"), "text"))
    two = {r["doc_id"]: r for r in sharding.assign(more, 4, 256, path).collect()}
    assert all(two[i]["shard"] == r["shard"] and two[i]["map_version"] == 0 for i, r in one.items())
    sharding.add_shard(sharding.slotted(sharding.records(more), 256), path, 4, 256)
    three = {r["doc_id"]: r for r in sharding.assign(more, 4, 256, path).collect()}
    assert {r["map_version"] for r in three.values()} == {1} and len(three) == 6000
    moved = {i for i in two if three[i]["shard"] != two[i]["shard"]}
    assert moved and all(three[i]["shard"] == 4 for i in moved)
    assert sharding.load_map(spark, path, 0).count() == sharding.load_map(spark, path, 1).count() == 256


def test_growing_moves_rows_only_to_the_new_shard(spark):
    loads = spark.range(64).select(F.col("id").cast("int").alias("vslot"), (F.col("id") * 7 % 31 + 1).alias("bytes"))
    first = sharding.first_map(loads, 4)
    grown = sharding.grow_map(first, loads, 4)
    a = {r["vslot"]: r["shard"] for r in first.collect()}
    b = {r["vslot"]: r["shard"] for r in grown.collect()}
    assert set(a) == set(b) == set(range(64)) and {r["version"] for r in grown.collect()} == {1}
    assert all(b[k] in (a[k], 4) for k in a)
    weight = {r["vslot"]: r["bytes"] for r in loads.collect()}
    moved = sum(weight[k] for k in b if b[k] == 4)
    assert 0.5 * sum(weight.values()) / 5 < moved <= sum(weight.values()) / 5


# language ID


def train_rows():
    data = {"en": "the and of to in that was with for house garden water", "de": "der die und das nicht mit ist haus garten wasser über", "ru": "это и не на что дом сад вода"}
    return [(100 + n, " ".join(np.random.default_rng(n).permutation(text.split())), lang, "s") for n, (lang, text) in enumerate((k, v) for k, v in data.items() for _ in range(20))]


def test_language_of_texts_and_spans(spark, docs, nothing):
    model = langid.fit(documents(spark, train_rows()), 10)
    assert model.langs == ["de", "en", "ru"]
    out = langid.label(docs, model).collect()
    letters = {i: any(unicodedata.category(c)[0] == "L" for c in t or "") for i, t, _, _ in ROWS}
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(i for i, _, _, _ in ROWS)
    for r in out:
        assert (r["lang"] == "und") == (not letters[r["doc_id"]]) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["lang"] for r in out}
    assert by[9] == "de" and by[1] == "en"
    labeller = langid.Labeller(model)
    assert labeller.label("дом и сад")[0] == "ru"
    mixed = "the house and the garden and the water of the garden " * 3 + "der garten und das haus und das wasser ist nicht über " * 3
    found = labeller.spans(mixed)
    assert [k for _, _, k in found] == ["en", "de"]
    assert langid.fit(nothing) is None
    assert [r["lang"] for r in langid.label(docs, None).collect()] == ["und"] * len(ROWS)
    assert langid.label(nothing, model).count() == 0
    spans = langid.label_spans(docs, model).collect()
    assert {r["doc_id"] for r in spans} == {i for i, has in letters.items() if has}


def plain_viterbi(scores, penalty):
    total, back = scores[0].astype(float), []
    for row in scores[1:]:
        options = total[None, :] - penalty * (1 - np.eye(len(total)))
        back.append(options.argmax(axis=1))
        total = options.max(axis=1) + row
    best, path = int(total.argmax()), []
    for b in reversed(back):
        path.append(best)
        best = int(b[best])
    return [*path, best][::-1], total.max()


def test_texts_without_letters_have_no_language(spark):
    model = langid.fit(documents(spark, train_rows()), 10)
    labeller = langid.Labeller(model)
    for text in (None, "", " ", "½ ²", "①", "Ⅷ ⅷ", "12 3.4", "😀 !?", "_ __", "\u0301", "٣ ४"):
        assert labeller.label(text) == ("und", 0.0) and labeller.spans(text) == []
    for text in ("a", "½ the ②", "①a", "ª", "дом", "漢"):
        assert labeller.label(text)[0] != "und"
    assert [k for _, _, k in labeller.spans("½the② дом")] == ["en", "ru"]


def test_scripts_narrow_the_languages(spark):
    labeller = langid.Labeller(langid.fit(documents(spark, train_rows()), 10))
    text = "the house and the garden дом and the water of the garden"
    assert [(text[a:b], k) for a, b, k in labeller.spans(text)] == [("the house and the garden", "en"), ("дом", "ru"), ("and the water of the garden", "en")]
    assert [k for _, _, k in labeller.spans("зжщ the house")] == ["ru", "en"]  # no trigram of it was ever seen
    many = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000))  # more words than the scores have room for at first
    fresh = langid.Labeller(labeller.model)
    assert fresh.spans(many) == fresh.spans(many) and fresh.spans(many)[-1][1] == len(many)
    assert labeller.label("λόγος λόγος")[1] == 0.0  # a script of no language leaves all of them


def brute_label(counts, text, penalty, path_of):
    """Language and score from trigram counts, by dictionaries; of equally good paths the one that ``path_of`` takes."""
    langs = sorted({k for k, _, _ in counts})
    table, grams = collections.Counter(), {t for _, t, _ in counts}
    script = collections.Counter()
    for lang, gram, n in counts:
        table[lang, gram] += n
        script[lang, unicodedata.name(gram[1]).split()[0]] += n
    sizes = {k: sum(n for (a, _), n in table.items() if a == k) for k in langs}
    mean = sum(sizes.values()) / len(langs)
    unseen = 0.5 * (len(grams) + 1) / (mean + 0.5 * (len(grams) + 1))

    words, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return "und", 0.0
    rows, shares = [], []
    for word in words:
        padded = "\x02" + word + "\x03"
        own = [padded[i : i + 3] for i in range(len(word))]
        uses = [script[k, unicodedata.name(word[0]).split()[0]] >= 0.02 * sum(n for (a, _), n in script.items() if a == k) for k in langs]
        uses = uses if any(uses) else [True] * len(langs)
        logs = [sum(np.log((1 - unseen) * table[k, g] / sizes[k] + unseen / (len(grams) + 1)) if g in grams else np.log(unseen / (len(grams) + 1)) for g in own) for k in langs]
        top = np.log(sum(np.exp(x) for x, u in zip(logs, uses, strict=True) if u))
        rows.append([max(x - top, -6.0) if u else -1000.0 for x, u in zip(logs, uses, strict=True)])
        shares.append([np.exp(r) * sum(table[k, g] > 0 for g in own) / len(own) for r, k in zip(rows[-1], langs, strict=True)])
    path, rows = path_of(words), np.array(rows)
    value = rows[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()
    assert value == pytest.approx(plain_viterbi(rows, penalty)[1], abs=1e-3)
    weight = [sum(len(w) for w, p in zip(words, path, strict=True) if p == k) for k in range(len(langs))]
    best = int(np.argmax(weight))
    return langs[best], sum(s[best] * len(w) for s, w in zip(shares, words, strict=True)) / sum(map(len, words))


def test_scores_against_brute_force(spark):
    counts = [(lang, t, n) for lang, t, _, n in langid._counts(langid._sample(documents(spark, train_rows()), 10))]
    labeller = langid.Labeller(langid.build(counts))
    rng = np.random.default_rng(11)
    pool = "the and house garden der nicht über wasser haus это дом вода zzz qwx ½ ②the λόγος Straße 漢字 x".split()
    texts = [" ".join(rng.choice(pool, rng.integers(1, 40))) for _ in range(120)] + [t for _, t, _, _ in ROWS if t and len(t) < 500]

    def path_of(words):
        rows = labeller.rows_of(words)
        return langid.switching_path(labeller.scores[rows])

    for text in texts:
        got, want = labeller.label(text), brute_label(counts, text, langid.SWITCH, path_of)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-5), text


def test_viterbi_finds_a_best_path():
    rng = np.random.default_rng(3)
    for n in range(60):
        scores = np.maximum(np.log(rng.dirichlet(np.ones(4) * 0.3, 1 + n % 40)), -6)
        if n % 2:
            scores[: len(scores) // 2, 0] += 3
        path = langid.switching_path(scores, 4.0)
        value = scores[np.arange(len(scores)), path].sum() - 4.0 * (np.diff(path) != 0).sum()
        assert value == pytest.approx(plain_viterbi(scores, 4.0)[1], abs=1e-6)


def test_keep_known_drops_only_texts_without_language(spark, docs):
    kept = langid.keep_known(docs.unionByName(with_clashes(documents(spark, train_rows()))), 0.3)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 2, 3, 7} <= ids and not ids & {4, 5, 6, 8}


def test_language_model_and_cut_come_from_all_documents(spark):
    rows = [(i, f"the house and garden {'x' * (1 + i % 7)} number word", "en", "web") for i in range(4500)]
    rows += [(9000 + i, "das haus und der garten über wasser", "de", "web") for i in range(600)]
    frame = documents(spark, rows)
    counts = langid._counts(langid._sample(frame, langid.TRAIN_DOCS))
    assert sum(n for lang, t, _, n in counts if (lang, t) == ("en", "\x02th")) == 4500
    model, cut = langid.fit_with_cut(frame, 0.01)
    assert (model.logs == langid.fit(frame).logs).all() and model.langs == ["de", "en"]
    trials = [langid.Labeller(langid.build([(lang, t, n) for lang, t, fold, n in counts if fold != k])) for k in range(langid.ASIDE)]
    judged = [(r["lang"], *trials[r["fold"]].label(r["text"])) for r in langid._sample(frame, None).collect()]
    scores = [score for lang, found, score in judged if lang == found]
    assert len(scores) > 5000
    assert cut == pytest.approx(langid.MARGIN * float(np.quantile(scores, langid.LOST, method="lower")))


def test_keep_known_rejects_foreign_scripts_and_letter_junk(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(5)
    consonants = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(2, 9))) for _ in range(60))
    letters = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(60))
    russian, greek = "обычный русский текст о погоде и реке", "ένα ελληνικό κείμενο για τον καιρό"
    bad = ["今天天气很好我们去公园散步", consonants, letters, russian, greek, "bu hava durumu ve nehir hakkında sıradan bir türkçe metindir"]
    rows = [(-1 - i, t, None, "junk", len(t)) for i, t in enumerate(bad)]
    kept = langid.keep_known(given.unionByName(spark.createDataFrame(rows, DOCS)), 0.3)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not [i for i in ids if i < 0]
    assert len(ids) >= 0.998 * given.count()


def test_unseen_trigrams_favour_no_language():
    counts = [("aa", t, 1) for t in ("\x02ab", "abc", "bc\x03")] + [("bb", t, 1000) for t in ("\x02de", "def", "ef\x03")]
    model = langid.build(counts)
    assert np.ptp(model.logs[-1]) == 0
    labeller = langid.Labeller(model)
    assert labeller.label("xyz xyz")[1] == 0 and labeller.label("abc def def")[1] > 0.5


# media


def test_media_round_trip(spark, docs, nothing):
    stored = media.store(docs)
    out = media.with_contents(media.with_headers(stored)).collect()
    assert len(out) == len(ROWS)
    want = collections.Counter()
    for i, t, _, _ in ROWS:
        raw = (t or "").encode()
        payload = media.pad(raw)
        assert len(payload) % 64 == 0 and payload
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    assert all(r["width"] == 64 and r["height"] * 64 == r["payload_bytes"] and r["bit_depth"] == 8 for r in out)
    same = collections.defaultdict(set)
    for r in out:
        same[r["payload_sha256"]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in same.values())
    assert media.store(nothing).count() == 0


def test_shards_are_tar_files_with_each_content_once(spark):
    import tarfile
    from urllib.parse import urlparse

    rows = media.store(documents(spark, [(i, t, None, None) for i, t in enumerate(["a", "a", "b"] * 5)]).coalesce(1)).collect()
    (shard,) = {r["shard"] for r in rows}
    with tarfile.open(urlparse(shard).path) as tar:
        members = {m.name: (m.offset_data, m.size) for m in tar.getmembers()}
    assert len(members) == 2
    assert all(members[f"{r['digest']}.png"] == (r["offset"], r["length"]) for r in rows)
    spread = media.store(documents(spark, [(i, t, None, None) for i, t in enumerate(["a", "a", None, "", "b"] * 5 + ["c", "d"])]).repartition(7)).collect()
    assert len(spread) == 27 and len({(r["shard"], r["offset"]) for r in spread}) == len({r["digest"] for r in spread}) == 5
    split = media.store(documents(spark, [(i, f"text {i}", None, None) for i in range(20)]).coalesce(1), shard_bytes=1024).select("shard").distinct().count()
    assert split > 2


# URLs


def brute_rule(host, path):
    fits = []
    for rule, verdict in urls.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_urls_and_rules(spark):
    given = [
        None, "", "no scheme", "http://Example.COM", "http://example.com/", "https://www.example.com/en/a?b#c", "http://x.example.com/en/", "http://a.net/es/1",
        "http://net/fr/", "http://a.org/x?y=://z", "http://h?q", "http://h#f", "://x/y", "http://notcom/", "http://a.com.evil.org/", "http://ÄB.com/é",
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(given)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    for r in urls.judge(pages).collect():
        url = given[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_propagation_follows_links_forwards_and_distrust_backwards(spark):
    edges = [("t", "a", 1), ("a", "b", 2), ("b", "t", 1), ("a", "c", 2), ("d", "bad", 3), ("e", "d", 1), ("t", "d", 1)]
    frame = spark.createDataFrame(edges, "source string, target string, links long")
    start = spark.createDataFrame([("trust", "t", 1.0), ("distrust", "bad", 1.0)], "kind string, host string, score double")
    got = {(r["kind"], r["host"]): r["score"] for r in urls.propagate(frame, start, 0.85, 1e-9).collect()}
    ways = [("trust", a, b, n) for a, b, n in edges] + [("distrust", b, a, n) for a, b, n in edges]
    nodes = sorted({(k, x) for k, a, b, _ in ways for x in (a, b)})
    at, total = {x: i for i, x in enumerate(nodes)}, collections.Counter()
    for kind, a, _, n in ways:
        total[kind, a] += n
    matrix, seed = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    for kind, a, b, n in ways:
        matrix[at[kind, b], at[kind, a]] += n / total[kind, a]
    seed[at["trust", "t"]] = seed[at["distrust", "bad"]] = 0.15
    want = np.linalg.solve(np.eye(len(nodes)) - 0.85 * matrix, seed)
    assert got == pytest.approx({x: want[i] for x, i in at.items() if want[i]}, abs=1e-7)
    assert got["distrust", "d"] > 0 and ("distrust", "c") not in got
    pages = [(1, "http://bad.net/es/1", None), (2, "http://d.org/", '<a href="http://bad.net/x">'), (3, "http://t.com/", '<a href=\'http://good.org\'>'), (4, "http://good.org/", ""), (5, "http://e.org", "<a href='http://d.org/'>"), (5, "http://e.org", "<a href='http://d.org/'>")]
    verdict = [(r["page_id"], r["verdict"]) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert collections.Counter(verdict) == collections.Counter([(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "block"), (5, "block")])
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_rounds_end_on_cycles_and_scores_do_not_depend_on_other_seeds(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", "d", 1), ("d", "c", 3)], "source string, target string, links long")
    one = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, score double")
    two = one.unionByName(spark.createDataFrame([("trust", "c", 1.0)], "kind string, host string, score double"))
    first = {r["host"]: r["score"] for r in urls.propagate(edges, one).collect()}
    second = {r["host"]: r["score"] for r in urls.propagate(edges, two).collect()}
    assert first == pytest.approx({"a": 0.15 / (1 - 0.85**2), "b": 0.15 * 0.85 / (1 - 0.85**2)}, abs=6 * urls.TOLERANCE)
    assert {k: second[k] for k in "ab"} == pytest.approx(first) and second["c"] == pytest.approx(first["a"])


def test_every_linker_of_a_popular_blocked_host_is_blocked(spark):
    pages = [(0, "http://bad.net/es/1", None), (1, "http://good.org/", "<a href='http://other.org/'>")]
    pages += [(2 + k, f"http://h{k}.org/", "<a href='http://bad.net/x'>") for k in range(40)]
    out = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {k: "allow" if k == 1 else "block" for k in range(42)}


# quality


def brute_counts(text):
    words = WORDS.findall(text or "")
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_quality_counts(spark, docs):
    extra = ["a a a a", "a b c a b c", "x\nx\n\n \nx", "a b", "#*$%&|<>", "a\x0bb\x1cc\u00a0d", "one two three " * 40]
    frame = docs.unionByName(with_clashes(documents(spark, [(100 + i, t, "en", "s") for i, t in enumerate(extra)])))
    texts = {i: t for i, t, _, _ in ROWS} | {100 + i: t for i, t in enumerate(extra)}
    out = quality.signals(frame, keep=["doc_id"]).collect()
    assert len(out) == len(ROWS) + len(extra)
    for r in out:
        n, chars, symbols, dup, repeat = brute_counts(texts[r["doc_id"]])
        assert (r["_w"]["n_words"], r["_w"]["word_chars"], r["_symbols"], r["_l"]["n_dup_lines"], r["_w"]["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["_failed"] == (n < 50 or 100 * repeat > 50 * n)


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 10), (3, 10), (10, 10), (5, 847), (40, 5000), (0, 0), (49, 5000), (50, 5000), (51, 5000), (90, 5000), (1, 100)]
    frame = spark.createDataFrame(cases, "k long, n long")
    for r in frame.select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        want = sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_binomial_tail_of_very_many_trials(spark):
    n = 300_000_000
    frame = spark.createDataFrame([(n // 100 - d, n) for d in (0, 1000, 4000)], "k long, n long")
    got = [r["p"] for r in frame.select(quality.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p")).collect()]
    from statistics import NormalDist

    deviation = (n * 0.01 * 0.99) ** 0.5
    assert got == pytest.approx([NormalDist().cdf((0.5 - d) / deviation) for d in (0, 1000, 4000)], rel=5e-3)


def test_cutoffs_reject_junk_and_control_good_texts(spark):
    rng = np.random.default_rng(5)
    vocabulary_ = [f"w{i}" for i in range(3000)]
    rows, marks = [], []
    for i in range(2600):
        words = list(rng.choice(vocabulary_, 60))
        junk = i % 10 == 0
        text = " ".join(w + "###" if junk else w for w in words)
        rows.append((i, text, "en", "s"))
        marks.append((i, 0 if junk else 1, 0))
    labels = spark.createDataFrame([*marks, (0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    cutoffs = quality.calibrate(quality.signals(docs), labels).collect()
    assert len(cutoffs) == 1 and cutoffs[0]["_cut_symbols"] is not None
    assert cutoffs[0]["_cut_symbols"] == 0.3 and cutoffs[0]["_cut_capitals"] is None
    kept = {r["doc_id"] for r in quality.keep_good(with_clashes(docs), labels).collect()}
    assert kept == {i for i in range(2600) if i % 10}
    assert quality.calibrate(quality.signals(docs.filter("doc_id < 90")), labels).count() == 1  # 0.96 ** 81 < 0.05
    assert quality.calibrate(quality.signals(docs.filter("doc_id < 80")), labels).count() == 0  # 0.96 ** 72 > 0.05
    nobody = labels.limit(0)
    assert quality.keep_good(docs, nobody).count() == 2600


def test_quality_on_an_empty_table(spark, nothing):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(nothing, labels).count() == 0


# WARC


def test_revisits(spark):
    html = {"etag": '"1"', "content-type": "text/html", "content-length": "5", "last-modified": "x"}
    rows = [
        (1, "response", "http://A.com/x/", 10, html, "p1"),
        (2, "response", "https://a.com:443/x#f", 20, html | {"etag": '"2"'}, "p2"),
        (3, "revisit", "http://a.com/x?utm_source=y", 20, {"etag": 'W/"1"', "date": "d", "content-length": "0"}, None),
        (4, "revisit", "http://a.com/x", 21, {"etag": '"2"'}, None),
        (5, "revisit", "http://a.com/x", 5000, {"etag": '"9"'}, None),
        (6, "revisit", "http://a.com/x", 5000, {"date": "d"}, None),
        (7, "revisit", "http://a.com/other", 5000, {"etag": '"1"'}, None),
        (8, "revisit", None, 5000, {"etag": '"1"'}, None),
        (9, "response", "http://b.com/", 1, {}, "p9"),
        (10, "revisit", "http://b.com", 5, {"etag": '"1"'}, None),
        (11, "revisit", "http://a.com/x", 5000, {"last-modified": "x"}, None),
        (12, "response", None, 1, html, "p12"),
        (13, "response", "http://c.com/", 1, {"ETag": '"7"', "Content-Type": "a/b", "etag": '"8"'}, "p13"),
        (14, "revisit", "http://c.com/", 5, {"ETAG": '"7"', "Content-Length": "0", "DATE": "d"}, None),
        (15, "revisit", "http://c.com/", 5, None, None),
        (16, "response", "http://d.com/", 1, None, "p16"),
        (17, "revisit", "http://d.com/", 5, {"etag": '"7"'}, None),
    ]
    frame = spark.createDataFrame(rows, "record_id long, kind string, url string, time long, headers map<string,string>, payload_digest string").withColumn("key", F.lit("clash")).withColumn("status", F.lit(0))
    out = {r["record_id"]: r for r in warc.resolve(frame, span=8).collect()}
    assert {k: (r["status"], r["refers_to"]) for k, r in out.items()} == {
        3: ("resolved", 1), 4: ("resolved", 2), 5: ("mismatch", 2), 6: ("unverified", 2), 7: ("orphan", None), 8: ("orphan", None), 10: ("unverified", 9), 11: ("resolved", 2),
        14: ("resolved", 13), 15: ("unverified", 13), 17: ("unverified", 16),
    }
    assert out[3]["headers"] == {"etag": 'W/"1"', "date": "d", "content-length": "5", "content-type": "text/html", "last-modified": "x"}
    assert out[14]["headers"] == {"etag": '"7"', "content-type": "a/b", "date": "d"} and out[15]["headers"] == {}
    assert out[3]["payload_digest"] == "p1" and out[5]["payload_digest"] is None
    assert warc.resolve(frame.limit(0)).count() == 0
    wide = {r["record_id"]: r["refers_to"] for r in warc.resolve(frame, span=10**9).collect()}
    assert wide == {k: r["refers_to"] for k, r in out.items()}


def test_canonical_urls(spark):
    given = {"HTTP://Ex.com:80/A/?b=2&a=1&utm_x=3&ref=q#z": "ex.com/A?a=1&b=2", "https://ex.com": "ex.com", "ex.com/a?": "ex.com/a", "": ""}
    frame = spark.createDataFrame([(u,) for u in given], "u string")
    assert {r["u"]: r["k"] for r in frame.select("u", warc.canonical_url(F.col("u")).alias("k")).collect()} == given


# near copies


def brute_classes(rows):
    sets = []
    for _, text, _, _ in rows:
        words = re.findall(r"\w+", (text or "").lower())
        n = min(5, len(words))
        sets.append(frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset())
    texts = [t or "" for _, t, _, _ in rows]

    def linked(i, j):
        return texts[i] == texts[j] or bool(sets[i]) and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])

    links = [[j for j in range(len(rows)) if j != i and linked(i, j)] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
    ids = collections.defaultdict(list)
    for k, r in zip(label, rows, strict=True):
        if r[0] is not None:
            ids[k].append(r[0])
    return collections.Counter((r[0], min(ids[k], default=None), len({texts[j] for j in n} - {t})) for r, k, n, t in zip(rows, label, links, texts, strict=True))


def variants(n, seed):
    """Texts at many similarities around the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"word{i}" for i in range(80)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.choice(80, rng.integers(0, 6), replace=False):
            words[at] = f"other{rng.integers(1000)}"
        out.append(" ".join(words))
    return out


def test_jaccard_join_against_all_pairs(spark, docs, nothing):
    rows = ROWS + [(1000 + i, t, "en", "v") for i, t in enumerate(variants(60, 1))] + [(2000 + i, t.upper() + "!", "en", "v") for i, t in enumerate(variants(15, 2))]
    got = jaccard.join(with_clashes(documents(spark, rows))).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)
    assert jaccard.join(nothing).count() == 0


def test_jaccard_join_splits_large_groups_and_runs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "RUN", 5)
    rows = [(i, t, "en", "v") for i, t in enumerate(variants(80, 3))]
    got = jaccard.join(documents(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def test_very_long_sets_get_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 150)
    rows = [(i, t, "en", "v") for i, t in enumerate(variants(20, 4))]
    got = jaccard.join(documents(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def test_partitions_do_not_matter(spark):
    rows = ROWS + [(1000 + i, t, "en", "v") for i, t in enumerate(variants(60, 5))]
    want = brute_classes(rows)
    for parts in (1, 7, 211):
        got = jaccard.join(documents(spark, rows).repartition(parts)).collect()
        assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_keep_one_of_each_class(spark, docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = collections.Counter(r["doc_id"] for r in rows)
    assert ids[1] + ids[2] + ids[3] == 1 and ids[7] == ids[9] == ids[11] == 1
    assert sum(r["text"] == "no id at all here" for r in rows) == 1
    assert sum(not r["text"] for r in rows) == 1


def test_keep_one_with_repeated_and_null_ids(spark):
    """Different texts under one id stay, copies without an id go."""
    one, two, three = variants(40, 6)[0], "quite another text about boats and rivers and the men who sail them home", "a third text, of foxes and of hens, that nobody else has written before today"
    rows = [(1, one, "en", "a"), (1, two, "en", "a"), (None, one, "en", "a"), (None, three, "en", "a"), (None, three, "en", "b"), (5, three + " indeed", "en", "c")]
    kept = jaccard.keep_one(documents(spark, rows), 0.6).collect()
    assert len(kept) == 3 and {r["text"] for r in kept} - {three + " indeed"} >= {one, two} and len({r["text"] for r in kept} & {three, three + " indeed"}) == 1


def test_the_prefix_is_shortened_until_both_recalls_reach_the_target():
    enough = [1000] * jaccard.DEPTH
    k = jaccard.matched_depth(0.8, 0.999, 24, enough, 1000)
    assert jaccard.expected_recall(0.8, k) >= 0.999 > jaccard.expected_recall(0.8, k + 1)
    assert jaccard.matched_depth(0.8, 0.999, 24, [1000, 1000, 1000, 990, 980, 900, 800, 700], 1000) == 3
    assert jaccard.trees_for(0.8) == jaccard.TREES
    for threshold in (0.3, 0.5):
        assert jaccard.expected_recall(threshold, 3, jaccard.trees_for(threshold)) >= jaccard.RECALL
    with pytest.raises(ValueError):
        jaccard.trees_for(0.001)


def test_a_low_threshold_gets_more_tries(spark):
    texts = variants(30, 9)
    words = texts[0].split()
    rows = [(0, texts[0], "en", "v"), (1, " ".join(words[:45] + [f"new{i}" for i in range(25)]), "en", "v"), (2, "nothing like the others at all, not one word of it", "en", "v")]
    got = {r["doc_id"]: r["class_id"] for r in jaccard.join(documents(spark, rows), 0.3).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_runs_give_a_forest_of_all_pairs_that_are_near():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (12, 3), np.uint64)
    bits = base[rng.integers(0, 12, 300)] ^ (np.uint64(1) << rng.integers(0, 60, (300, 3)).astype(np.uint64))
    key = rng.integers(0, 9, 300)
    table = jaccard.pa.table({"tree": np.zeros(300, np.int32), "key": key, "node": np.arange(300) * 7, "block": np.zeros(300, np.int32), "left": np.zeros(300, np.int32), "right": np.zeros(300, np.int32), "bits": [b.tobytes() for b in bits]})
    out = jaccard._linker(6)(table).to_pydict()
    one, two = np.triu_indices(300, 1)
    near = (key[one] == key[two]) & (np.bitwise_count(bits[one] ^ bits[two]).sum(axis=1) <= 6)

    def groups(a, b):
        label = {i * 7: i * 7 for i in range(300)}
        for _ in range(40):
            for x, y in zip(a, b, strict=True):
                label[x] = label[y] = min(label[x], label[y])
        return label

    assert groups(out["a"], out["b"]) == groups((one[near] * 7).tolist(), (two[near] * 7).tolist())
    assert len(out["a"]) < 300


def test_jaccard_join_finds_near_copies_around_a_hot_passage(spark):
    rng = np.random.default_rng(8)
    hot, rows = [f"hot{i}" for i in range(60)], []
    for k in range(600):
        own = [f"own{k}x{i}" for i in range(40)]
        near = list(own)
        near[int(rng.integers(0, 40))] = "other"
        rows += [(2 * k, " ".join(hot + own), "en", "h"), (2 * k + 1, " ".join(hot + near), "en", "h")]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = {r["doc_id"]: r["class_id"] for r in jaccard.join(documents(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(1200)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# packing


def check_packing(spark, frame, texts, capacity):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(packing.pieces(frame, path, capacity), capacity, 64).collect()
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    want = collections.Counter()
    for own in ids:
        for n, at in enumerate(range(0, len(own), capacity)):
            want[n, at, len(own[at : at + capacity]), zlib.crc32(np.array(own[at : at + capacity], "<u4").tobytes())] += 1
    assert collections.Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    rooms = collections.defaultdict(list)
    for r in out:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for room in rooms.values():
        at = 0
        for offset, length in sorted(room):
            assert offset == at
            at += length
        assert at <= capacity
    return len(rooms), -(-sum(map(len, ids)) // capacity)


def test_packing_holds_every_piece_once(spark, docs, nothing):
    check_packing(spark, docs, [t for _, t, _, _ in ROWS], 2048)
    n, bound = check_packing(spark, documents(spark, [(i, "word " * (1 + i * 37 % 400), None, None) for i in range(800)]), ["word " * (1 + i * 37 % 400) for i in range(800)], 512)
    assert n <= 1.03 * bound + 1
    assert packing.pack(packing.pieces(nothing, vocabulary("word_bpe_49k.json"))).count() == 0


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(1)
    for scale in (3, 400):
        histogram = {int(k): int(v) for k, v in enumerate(rng.integers(0, scale, 2049)) if k}
        runs = packing.plan(histogram)
        used = collections.Counter()
        for n, lengths in runs:
            assert n > 0 and sum(lengths) <= 2048
            for length in lengths:
                used[length] += n
        assert used == collections.Counter({k: v for k, v in histogram.items() if v})
        bound = -(-sum(k * v for k, v in histogram.items()) // 2048)
        assert sum(n for n, _ in runs) <= 1.02 * bound + 2


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(2)
    for _ in range(5):
        a, b = rng.random((20, 30)), rng.normal(size=20)
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient < 1e-6).all() and abs(gradient[x > 1e-9]).max(initial=0) < 1e-6


def fuzz_texts(n, seed=7):
    """Strings of letters of many kinds, marks, capitals, stops, contractions, controls and spaces."""
    rng = np.random.default_rng(seed)
    atoms = list("aezİIıſŉǅΣςÅÉÿŸßẞфЯ\u0301\u0307\u0300\u0327é.,;:!?'#$%-_09½Ⅷ①中文かﬁשׁ\ufb2a\ufb1f한\u1112\u1161 \n\t\x00\u00a0\u2003😀")
    atoms += ["'s", "'LL", "İ.", "BELEDİYESİ", "<|endoftext|>", "word", "THE", "  ", "Σ,", "é́"]
    return ["".join(atoms[k] for k in rng.integers(0, len(atoms), size)) for size in rng.integers(0, 14, n)]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [
        "Don't stop.Now! İstanbul ΣΑΣ ΟΔΟΣ. é ́x é <|endoftext|> a<|startoftext|>B <|ENDOFTEXT|>  x\x1cy\tz\r\nq 123 4,5. ½ Ⅷ K Å Ω 中文。\x00 x",
        "", "   ", "\n\n", "a" * 5000, "'S 'Ll I'M 'stop. 's, ǅ ǅ. ﬁ ŉ.", BASE, NEAR, "BELEDİYESİ. GAZETESİ, İ.", "x.\u0301 x\u0301. .\u0301",
    ]
    texts = odd + fuzz_texts(100_000)
    whole = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for text in odd:
        assert tokenizer.encode(text, add_special_tokens=False).ids == tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
    found = packing.TextIds(path)
    assert found.apart
    assert list(found.of(texts)) == whole
    found.apart = False
    assert list(found.of(texts[:2000])) == whole[:2000]


def test_a_tokenizer_that_keeps_spaces_gets_whole_texts():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    found, tokenizer = packing.TextIds(path), Tokenizer.from_file(path)
    assert not found.apart
    for text, ids in zip(texts := fuzz_texts(2000, 8), found.of(texts), strict=True):
        assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# SentencePiece


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(n, value):
    return varint(n << 3 | 2) + varint(len(value)) + value


@pytest.fixture(scope="module")
def model():
    return pieces.Model(vocabulary("piece_bpe_32k.model"))


def best_score(model, text):
    """Brute force over all segmentations by memo."""
    usable = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k in (pieces.NORMAL, pieces.USER)}
    score = [0.0] + [-1e18] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            value = usable.get(piece, model.unknown_score if len(piece) == 1 else None)
            if value is not None:
                score[end] = max(score[end], score[start] + value)
    return score[-1]


def score_of(model, ids):
    """Score of ids, each spelled character counted as one unknown."""
    spelled = bytes(model.byte_ids.index(i) for i in ids if model.kinds[i] == pieces.BYTE)
    return sum(model.scores[i] for i in ids if model.kinds[i] != pieces.BYTE) + model.unknown_score * len(spelled.decode())


def test_trie_finds_all_prefixes(model):
    usable = {p.encode(): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (pieces.NORMAL, pieces.USER)}
    for text in ("▁there", "▁größer", "xyz", "日本", ""):
        data = text.encode()
        want = {(n, usable[data[:n]]) for n in range(1, len(data) + 1) if data[:n] in usable}
        assert set(model.trie.prefixes(data, 0)) == want
    assert all((len(k), i) in set(model.trie.prefixes(k, 0)) for k, i in list(usable.items())[::97])


def test_segmentations_are_best(model):
    for text in ("the quick brown fox", "größer als $$$ der!!", "日本語テスト", "a\nb  c", "don't (stop)…", "\U0001f600x"):
        normal = model.normalize(text)
        assert score_of(model, model.encode(text)) == pytest.approx(best_score(model, normal), abs=1e-6)
        assert model.decode(model.encode(text)) == text


def test_agrees_with_the_public_library(model):
    import struct

    import sentencepiece

    proto = b"".join(
        field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k))
        for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True)
    )
    proto += field(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1))
    proto += field(3, field(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    for text in [BASE, NEAR, "Straße größer als der Garten", "日本語のテキスト \U0001f600", "  two  spaces ", "x\ny\n\n", ""]:
        assert model.encode(text) == library.encode(text)
        assert model.decode(model.encode(text)) == library.decode(library.encode(text))


def test_encoding_all_rows(spark, docs, nothing, model):
    path = vocabulary("piece_bpe_32k.model")
    out = pieces.encode_and_check(docs, path).collect()
    assert len(out) == len(ROWS) and all(r["round_trip"] for r in out)
    texts = collections.Counter(len(t or "") for _, t, _, _ in ROWS)
    assert collections.Counter(r["n_chars"] for r in out) == texts
    back = pieces.decode(pieces.encode(docs, path), path)
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter((i, t or "") for i, t, _, _ in ROWS)
    assert pieces.encode_and_check(nothing, path).count() == 0
    assert model.encode(LONG[:5000]) == [i for r in [LONG[:5000]] for i in np.frombuffer(pieces.WordIds(model).of(r), "<u4").tolist()]
