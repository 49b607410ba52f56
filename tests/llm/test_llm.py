"""Operators against brute force, round trips and held-out rows, on small made-up tables."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sondeur.llm import chat, common, fingerprint, language, lm, mixing, neighbours, packing, sharding, simhash, toxicity

WORDS = "the of and to in that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, topic string, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 9) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(5, 200))) + ("\n" + " ".join(r.choices(WORDS, k=20))) * (i % 3), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)]  # exact copies
    rows += [(200 + i, rows[20 + i][1] + " tail", "en", "s1") for i in range(5)]  # near copies
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n ", "en", "s1"), (303, "word " * 30_000, "en", "s2"), (None, "a null id with a text", "en", "s3"), (59, rows[59][1], "en", "s3"), (304, "Ünïcode ťëxt ñ 漢字 \U0001f600 end", "de", "s0")]
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_lm_scores(spark, docs, empty):
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in lm.score(own).collect()}
    c = duckdb.connect()
    documents = own.select("doc_id", "text").toPandas()  # noqa: F841  read by the SQL
    want = c.sql(lm.ORACLE).df()
    assert len(want) == len(got)
    for w in want.itertuples():
        g = got[w.doc_id]
        assert (g.n_words, g.n_trigram, g.n_bigram, g.n_unigram) == (w.n_words, w.n_trigram, w.n_bigram, w.n_unigram)
        assert g.log_score == pytest.approx(w.log_score, abs=1e-3)
    assert lm.score(empty).count() == 0 and lm.score(docs).count() == docs.count()


def test_language(spark, empty):
    r = random.Random(5)
    kinds = {"en": "the thing other whether with", "de": "schule strasse gleich nicht sich", "ru": "что это как так мир"}
    say = lambda k, n: " ".join(r.choices(kinds[k].split(), k=n))
    train = table(spark, [(i, say(k, 40), k, "s") for i, k in enumerate([*kinds] * 20)])
    model = language.fit(train)
    asked = table(spark, [(0, say("en", 20), None, None), (1, say("de", 30) + " " + say("ru", 12), None, None), (2, None, None, None), (3, "12 34 --", None, None), (4, "漢字", None, None), (5, "", None, None)])
    got = {x.doc_id: x for x in language.identify(asked, model, spans=True).collect()}
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de" and 0.5 < got[1].score < 1
    assert [s.lang for s in got[1].spans] == ["de", "ru"]
    assert [got[i].lang_pred for i in (2, 3, 5)] == ["und"] * 3 and got[4].lang_pred in kinds and got[4].score == 0
    assert {x.doc_id for x in language.keep(asked, model, 0.3).collect()} == {0, 1}
    assert language.identify(empty, model).count() == 0
    assert {x.lang_pred for x in language.identify(asked, language.fit(empty)).collect()} == {"und"}


def test_viterbi_is_best():
    r = np.random.default_rng(1)
    score = r.normal(0, 3, (40, 3)).astype(np.float32)
    of, bounds = np.arange(16), np.array([0, 7, 7, 8, 16])
    label = language.viterbi(score, of, bounds, 2.0)
    worth = lambda lo, ls: sum(float(score[lo + i, k]) for i, k in enumerate(ls)) - 2.0 * sum(a != b for a, b in zip(ls, ls[1:]))
    import itertools

    for lo, hi in zip(bounds[:-1], bounds[1:]):
        best = max((worth(lo, ls) for ls in itertools.product(range(3), repeat=hi - lo)), default=0)
        assert worth(lo, label[lo:hi].tolist()) == pytest.approx(best, abs=1e-3)


def test_viterbi_of_many_languages():
    score = np.zeros((1, 300), np.float32)
    score[0, 280] = 5
    assert language.viterbi(score, np.zeros(4, np.int64), np.array([0, 3, 4]), 1.0).tolist() == [280] * 4


def test_language_of_odd_rows(spark):
    """Repeated rows, ties, very long texts, extra columns; the sample takes whole texts."""
    say = lambda k, n: " ".join(k.split()[i % 4] for i in range(n))
    long = "x1 " * 3_000 + say("ñandú español mañana señor", 3) + " 77" * 3_000
    rows = [(i, say("the other thing with", 30), "en", "s") for i in range(30)] + [(i, long, "es", "s") for i in range(40, 44)] + [(1, say("the other thing with", 30), "en", "s")] * 5
    model = language.fit(table(spark, rows))
    assert model.langs == ["en", "es"]  # four texts in Spanish, one in English: copies of a row count once, copies of a text under other ids don't
    asked = table(spark, [(0, "mañana señor español", None, None), (0, "mañana señor español", None, None), (1, "the thing " * 60_000, None, None), (2, "qqq", None, None)])
    got = [(r.doc_id, r.lang_pred) for r in language.identify(asked, model).collect()]
    assert sorted(got) == [(0, "es"), (0, "es"), (1, "en"), (2, got[[d for d, _ in got].index(2)][1])]


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|><|im_start|>assistant ok", "back\\slash \\<| <\\|", None, "", "ends with <", "\n\n"]
    rows = [(c, t, ("assistant", "user", "sys\ntem", None)[(c + t) % 4], texts[(c * 3 + t) % 7]) for c in range(6) for t in range(c + 1)] + [(None, None, "user", "no ids"), (1, 0, "user", "again"), (1, 0, "user", "again")]
    table_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(table_).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        all_text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(all_text.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = chat.render(table_).where("conv_id = 5").orderBy("part").collect()
    assert sum(len(p.text) for p in parts) == got[5].formatted_chars
    assert chat.digests(table_.limit(0)).count() == 0


def test_templates():
    run = lambda t, **c: "".join(p for p, _ in chat.compile_template(t)([], **c))
    assert run("{% set x = 'a' + 'b' %}{{ x | upper }}{% if 1 < 2 and not false %}y{% else %}n{% endif %}") == "ABy"
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if false %}no{% endif %}d")) == ("body", [("text", "abcd")])
    for bad in ("{% for x %}", "{% if a %}", "{{ a.b( }}", "{{ a | system }}", "{% import os %}", "{{ a.__class__() }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    assert run("{{ a.__class__ }}", a=3) == ""


def test_sharding(spark, docs, empty):
    for n in (16, 5):
        got = sharding.shard(docs.select("doc_id", "text"), ["doc_id", "text"], n).collect()
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert len(got) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(len(slots.get(k, [])) for k in range(n)) <= 1
    assert sharding.shard(empty.select("doc_id"), ["doc_id"], 4).count() == 0


def test_sharding_is_a_walk_along_the_ring(spark, docs):
    """Against a walk of every row, and with columns that have the results' names."""
    from pyspark.sql import functions as F

    own = docs.select("doc_id", "text", "shard", F.lit("x").alias("_place")).distinct()
    places = {(r.doc_id, r.text): r.p for r in own.select("doc_id", "text", F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 60) - 1)).alias("p")).collect()}
    points, n = sharding.ring(5, 8), len(places)
    room = sharding.capacities(n, points, 5)
    waiting = {}
    for k, p in sorted(places.items(), key=lambda x: (x[1], x[0][0] is not None, x[0][0] or 0, x[0][1] is not None, x[0][1] or "")):
        waiting.setdefault(sharding.place_of(p, points), []).append(k)
    want, used = {}, [0] * 5
    for step in range(len(points)):
        for arc in sorted(waiting):
            s = points[(arc + step) % len(points)][1]
            while waiting[arc] and used[s] < room[s]:
                want[waiting[arc].pop(0)] = (s, used[s])
                used[s] += 1
    got = sharding.shard(own, ["doc_id", "text"], 5, 8)
    assert got.columns == ["doc_id", "text", "_place", "shard", "slot"]
    assert {(r.doc_id, r.text): (r.shard, r.slot) for r in got.collect()} == want


def test_bounded_loads_move_few_rows(spark):
    """One more shard of 17 takes 1/17 of the rows; neither law moves many more."""
    rows = spark.range(4_000).withColumnRenamed("id", "doc_id")
    moved = {}
    for epsilon in (0.0, 0.25):
        a, b = ({r.doc_id: r.shard for r in sharding.shard(rows, ["doc_id"], n, 64, epsilon).collect()} for n in (16, 17))
        moved[epsilon] = sum(a[k] != b[k] for k in a) / len(a)
    assert all(1 / 20 < m < 0.2 for m in moved.values())


def test_quotas_are_walks_along_the_ring():
    points, r = sharding.ring(4, 8), random.Random(1)
    counts = {a: r.randint(0, 9) for a in range(len(points))}
    room = sharding.capacities(sum(counts.values()), points, 4)
    plan = sharding.quotas(counts, points, room)
    used = {}
    for _, a, b, s, first in plan:
        assert first == used.get(s, 0)
        used[s] = first + b - a
    assert used == {s: c for s, c in enumerate(room) if c}
    full = set()
    for a, lo, _, s, _ in plan:  # the first share of an arc goes to its own shard, unless that is full already
        if lo == 0 and s != points[a][1]:
            full.add(points[a][1])
    assert all(room[s] == used[s] for s in full)


def test_raking(spark, docs, empty):
    import pandas as pd

    r = np.random.default_rng(2)
    cells = pd.DataFrame([(s, g, t, int(r.integers(1, 90))) for s in "abc" for g in "xy" for t in "pq"], columns=["source", "lang", "topic", "tokens"])
    goal = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.5, "q": 0.5}}
    w = mixing.rake(cells, goal)
    for d in mixing.DIMENSIONS:
        assert cells.assign(w=w).groupby(d)["w"].sum().to_dict() == pytest.approx(goal[d], abs=1e-6)
    seen = mixing.described(docs)
    near, small = mixing.calibrate(seen)
    far, large = mixing.calibrate(seen, max_cells=0)
    assert small and not large
    key = lambda t: {(x["_source"], x["_lang"], x["_topic"]): x["probability"] for x in t.collect()}
    assert key(near) == pytest.approx(key(far), abs=1e-5)
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and mixing.mix(empty).count() == 0
    clashing = docs.selectExpr("*", "1 as _source", "2 as _u", "3 as _row", "4 as _tokens")
    again = mixing.mix(clashing)
    assert again.columns == clashing.columns and {(r.doc_id, r._source, r._u, r._row, r._tokens) for r in again.collect()} == {(r.doc_id, 1, 2, 3, 4) for r in kept.collect()}
    t = np.array([10.0, 20, 30])
    w = np.array([0.5, 0.3, 0.2])
    assert np.minimum(t, mixing.scale(t, w, 40) * w).sum() == pytest.approx(40)


def test_toxicity(spark, empty):
    r = random.Random(4)
    say = lambda bad: " ".join(r.choice(["vile", "rotten", "scummy"]) + " " + w if bad and r.random() < 0.2 else w for w in r.choices(WORDS, k=60))
    rows = [(i, say(i % 3 == 0), "en", "s") for i in range(400)]
    d = table(spark, rows + [(900, None, "en", "s"), (901, "", "en", "s"), (902, "ok " * 20_000, "en", "s")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels)
    got = {x.doc_id: x for x in toxicity.score(d, model).collect()}
    right = sum((got[i].score >= 0.5) == (i % 3 == 0) for i in range(300, 400))
    assert right >= 95 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    assert not any(got[i].predicted for i in (900, 901, 902))
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, labels).score("x") == 0


def test_toxicity_trains_on_whole_texts(spark):
    r = random.Random(6)
    say = lambda n: " ".join(r.choices(WORDS, k=n))
    rows = [(i, say(3_000) + f" rotten {'scummy' if i % 2 else 'vile'} " + say(3_000) if i % 2 == 0 or i % 3 == 0 else say(400), "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0 or i % 3 == 0)) for i in range(60)] + [(0, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    assert b" rotten " in model.toxic and b" rotten " not in model.ordinary and model.toxic[-5_000:] == model.ordinary[-5_000:]
    assert model.gains([b" that was for on are rotten with as his they be at "])[0] > 0


def test_gains_are_differences_of_lengths():
    """Against plain compression with each dictionary, of long windows too."""
    import zstandard

    r = random.Random(7)
    say = lambda n, bad: " ".join(r.choice(["rotten", "scummy"]) if bad and r.random() < 0.1 else w for w in r.choices(WORDS, k=n))
    model = toxicity.train([say(80, True) for _ in range(40)], [say(80, False) for _ in range(40)])
    pieces = [*toxicity.windows(say(90, True)), b"x" * 300_000, b" rotten " * 20_000, b""]
    for piece, gain in zip(pieces, model.gains(pieces)):
        size = []
        for content in (model.ordinary, model.toxic):
            how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, window_log=17, min_match=5, strategy=zstandard.STRATEGY_LAZY2, hash_log=16, chain_log=16, search_log=5, write_content_size=False, write_dict_id=False)
            packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(piece)
            size.append(len(packed))
        assert gain == size[0] - size[1]
    assert b" ".join(w.strip() for w in toxicity.windows("A b\u00a0c  d\ne " * 50)).split() == ("a b c d e " * 50).encode().split()


def test_neighbours(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, x[7].tolist()) for i in range(20)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0] * 3), (404, [None] * 8), (5, x[5].tolist()), (None, x[3].tolist())]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(t, lambda i: i % 50 == 0, leaf=40, share=1.0).collect()
    ok = [(i, np.array(v, float)) for i, v in dict(((i, tuple(v)), (i, v)) for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)).values()]
    for q, v in ((i, v) for i, v in ok if i is not None and i % 50 == 0):
        c = [(-float(neighbours.cosine(v[None], w[None])[0]), i is None, i or 0) for i, w in ok if i != q]
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [(g.vec_id is None, g.vec_id or 0) for g in own] == [(b, i) for _, b, i in sorted(c)[:5]]
        assert [-g.score for g in own] == pytest.approx([s for s, _, _ in sorted(c)[:5]], abs=1e-12)
    few = spark.createDataFrame([(50, [1.0, 0.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(g.query_id, g.vec_id) for g in neighbours.nearest(few, lambda i: i % 50 == 0).collect()] == [(50, 51)]
    assert neighbours.nearest(few.limit(0), lambda i: i % 50 == 0).count() == 0


def recall(t, every):
    rows = [(x.vec_id, x.embedding) for x in t.select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), neighbours.unit(np.array([v for _, v in rows], float))
    got = {}
    for g in neighbours.nearest(t, lambda i: i % every == 0).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    hits = []
    for k in np.flatnonzero(ids % every == 0):
        s = x @ x[k]
        s[k] = -2
        hits.append(len(set(ids[np.argsort(-s)[:5]].tolist()) & got[ids[k]]))
    return sum(hits) / 5 / len(hits)


@pytest.mark.parametrize("kind", ["isotropic 1200", "isotropic 6000", "groups", "sf0.01", "sf0.1"])
def test_recall_of_neighbours_as_registered(spark, kind):
    r = np.random.default_rng(9)
    if kind.startswith("sf"):
        if not os.path.isdir(f"/root/testdata/{kind}"):
            pytest.skip("no test tables")
        t = spark.read.parquet(f"/root/testdata/{kind}/embeddings.parquet")
    else:
        x = r.normal(size=(int(kind.split()[1]), 64)) if kind != "groups" else (r.normal(size=(200, 64)) + 0.3 * r.normal(size=(20, 200, 64))).reshape(-1, 64)
        t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert recall(t, 8) >= 0.9


def test_vectors_in_groups_need_a_small_share():
    r = np.random.default_rng(4)
    x = neighbours.unit((r.normal(size=(200, 64)) + 0.3 * r.normal(size=(20, 200, 64))).reshape(-1, 64))
    assert neighbours.searched(neighbours.fit(x, 6, 8), x, 5) < 0.05
    assert neighbours.searched(neighbours.fit(x[:500], 3, 8), neighbours.unit(r.normal(size=(500, 64))), 5) is None


def test_neighbours_of_odd_vectors(spark):
    """Clashing and extra columns, negative zeros, components whose squares overflow, the same vector under many ids, leaves in chunks."""
    rows = [(0, [2.0**700, 2.0**700, 0.0], 1, 9.0), (1, [2.0**-700, 2.0**-700, -0.0], 2, 9.0), (2, [1.0, 1.0, 0.0], 3, 9.0), (50, [1.0, 1.0, -0.0], 3, 9.0), (3, [0.0, 0.0, 5.0], 4, 9.0)] + [(100 + i, [0.0, 0.0, 5.0], 0, 0.0) for i in range(400)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, p int, score double")
    for how in ({}, {"together": 2, "leaf": 2}):
        got = {}
        for g in neighbours.nearest(t, lambda i: i % 50 == 0, **how).collect():
            got.setdefault(g.query_id, {})[g["rank"]] = (g.vec_id, round(g.score, 12))
        assert [got[0][k] for k in range(1, 6)] == [(1, 1.0), (2, 1.0), (50, 1.0), (3, 0.0), (100, 0.0)]
        assert [got[50][k][0] for k in range(1, 4)] == [0, 1, 2]
        assert [got[100][k] for k in range(1, 6)] == [(i, 1.0) for i in (3, 101, 102, 103, 104)] and sorted(got) == [0, 50, *range(100, 500, 50)]


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.packed(docs).collect()
    want = sorted((i, k, crc, n) for i, t in rows_of(docs) for k, crc, n in cut(whole.encode(t or "", add_special_tokens=False).ids + [1]) if i is not None)
    assert sorted((r.doc_id, r.piece, r.ids_crc32, r.length) for r in got if r.doc_id is not None) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.packed(empty).count() == 0


def cut(ids):
    for k in range(0, len(ids), 4096):
        part = np.array(ids[k : k + 4096], "<u4")
        yield k // 4096, zlib.crc32(part.tobytes()), len(part)


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    texts = ["It's Déjà-vu, OK?!", "a<|endoftext|>b <|ENDOFTEXT|>", "ΣΑΣ, İstanbul! ", "x\t\ty z  12,5%", "", "don't.!? ***word*** |a|", "café, ﬁne"]
    ids, bounds = packing.Encoder(packing.tokenizer_path()).encode(pa.array(texts))
    whole = Tokenizer.from_file(packing.tokenizer_path())
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_encoder_learns_words_once():
    """Case and the marks at a word's end make no other word; letters that end in a combining mark keep their marks."""
    from tokenizers import Tokenizer

    encoder, whole = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    encoder.encode(pa.array(["Word WORD wOrd word word, Word. word!? Été, été"]))
    assert set(encoder.place) == {"word", ",", ".", "!?", "Été", "été"}
    r = random.Random(4)
    texts = ["".join(r.choices("aAzéÉß'’<>|- \n\t01½ſǅΣςİK漢Ж\u0301\u0307\ufb2a\u0958,.!?;:*$%#&", k=r.randint(1, 25))) for _ in range(20_000)] + ["A<|endoftext|>B, C.", "IT'S. we'LL;"]
    ids, bounds = packing.Encoder(packing.tokenizer_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_fingerprints(spark, docs, empty):
    got = fingerprint.fingerprints(docs).collect()
    order = sorted(((i, t or "") for i, t in rows_of(docs)), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n = len(t)
        want.append((i is None, i or 0, n, hashlib.sha256((t[: n - n // 3] + order[(k + 1) % len(order)][1][: n // 3]).encode()).hexdigest()))
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_chars, g.edited_sha256) for g in got) == sorted(want)
    by = {g.doc_id: g for g in got}
    assert all(by[i].fingerprint == by[100 + i].fingerprint for i in range(5)) and len({g.fingerprint for g in got}) > 60
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprints_add_up(spark):
    t = spark.createDataFrame([(0, "one line\nand two"), (1, "and two\none line"), (2, "one line"), (3, "and two")], "k long, text string")
    v = {r.k: r.vector for r in fingerprint.vectors(t, "text", ["k"]).collect()}
    assert v[0] == v[1] != v[2]
    pair = spark.createDataFrame([(v[2], v[3], v[0])], "a array<long>, b array<long>, c array<long>")
    got = pair.select(fingerprint.add(pair.a, pair.b).alias("s"), fingerprint.subtract(pair.c, pair.b).alias("d")).first()
    assert got.s == v[0] and got.d == v[2]


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = {}
    for i, t in rows_of(docs):
        words = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        prints[i, t] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{prints[i, t]:016x}") for i, t in rows_of(docs))
    nodes = [(i, prints[i, t]) for i, t in rows_of(docs)]
    root = list(range(len(nodes)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(nodes)):
        for b in range(a):
            if (nodes[a][1] ^ nodes[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(nodes):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted((i or -1, least.get(find(a)) or -1) for a, (i, _) in enumerate(nodes))
    assert simhash.near_duplicates(empty).count() == 0
    assert "_hash_of" in simhash.dedup(docs.selectExpr("*", "1 as _hash_of", "2 as _id")).columns
    kept = simhash.dedup(docs).collect()
    assert len(kept) <= len(set(least.values())) + 2 and kept[0].asDict().keys() == docs.first().asDict().keys() and simhash.dedup(empty).count() == 0


def test_dedup_finds_all_near_copies(spark):
    """Against all pairs; near copies lie up to 14 bits apart, and one large group shares a passage with texts unlike it."""
    r = random.Random(12)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, texts = say(60), []
    for n in (5, 6, 15, 25, 60, 150, 400):
        for _ in range(6):
            base = say(n)
            texts.append(base)
            for edits in (1, 2, 3, max(1, n // 50)):
                own = list(base)
                for k in r.sample(range(n), min(n, edits)):
                    own[k] = say(1)[0]
                texts.append(own)
    texts += [say(r.randint(3, 20)) + passage + say(r.randint(3, 20)) for _ in range(60)]
    group = say(80)
    texts += [[*group[:k], "new", *group[k:]] for k in range(80)]
    d = table(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]).repartition(3)
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    least = list(range(len(texts)))

    def find(a):
        while least[a] != a:
            a = least[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if 5 * same >= 4 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    want = {find(a) for a in range(len(texts))}
    assert len(want) < len(texts) - 100
    assert {x.doc_id for x in simhash.dedup(d).collect()} == want


def test_dedup_goes_by_fingerprints(spark, monkeypatch):
    """Without the exact way, dedup joins near copies that the tree finds; no intermediate table of it stays but the rows to keep."""
    r = random.Random(5)
    texts, close = [], 0
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(500)]
        prints = [simhash.majority(simhash.hashes(" ".join(t), 5)) for t in (base, [*base[:-1], "end"])]
        close += (prints[0] ^ prints[1]).bit_count() <= 3
        texts += [base, [*base[:-1], "end"]]
    assert close > 6
    tables, stored = [], common.stored

    def noted(df, name):
        out = stored(df, name)
        tables.append((name, out._stored_at.removeprefix("file://")))
        return out

    monkeypatch.setattr(common, "stored", noted)
    monkeypatch.setattr(simhash, "_centres", lambda sets: spark.createDataFrame([], "k int, centre long, node long"))
    d = table(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])
    assert simhash.dedup(d).count() == len(texts) - close
    assert {name for name, path in tables if os.path.exists(path)} == {"keep"}


def test_dedup_keeps_only_sets_that_it_compares(spark, monkeypatch):
    """Shingles of texts that are like no other are never written or shuffled whole, and the bitmap that finds the rest loses none."""
    r = random.Random(6)
    say = lambda n: " ".join(f"w{r.randrange(50_000)}" for _ in range(n))
    alone, base = [say(50) for _ in range(200)], [say(60) for _ in range(5)]
    texts = alone + [b for b in base for _ in range(3)] + [b + " end" for b in base]
    whole, stored = [], common.stored

    def noted(df, name):
        out = stored(df, name)
        if "shingles" in out.columns:
            whole.append(out.count())
        return out

    monkeypatch.setattr(common, "stored", noted)
    d = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    kept = sorted(x.doc_id for x in simhash.dedup(d).collect())
    assert kept == [*range(200), *range(200, 215, 3)]
    assert sum(whole) == 10
    hashed = stored(spark.range(3000).selectExpr("xxhash64(id) text_hash"), "some")
    for most in (1 << 10, 1 << 27):
        monkeypatch.setattr(simhash, "FILTER_MOST", most)
        flags = np.unpackbits(simhash._bitmap(hashed), bitorder="little")
        want = np.zeros(len(flags), bool)
        want[[x.text_hash % len(flags) for x in hashed.collect()]] = True
        assert len(flags) == (1 << 15 if most < 1 << 15 else 1 << 16) and (flags == want).all()


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(3)
    for n in (1, 30, 300, 800, 801, 5000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0, 0.02, 0.2, 1):
            b = np.unique(np.where(r.random(len(a)) < share, r.integers(0, 1 << 63, len(a), dtype=np.uint64), a))
            x, y = simhash.parities(a), simhash.parities(b)
            assert len(x) == len(y) and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("members", [1, 4, 1000])
def test_tree_finds_all_pairs(spark, members):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(150)]
    x = list({b ^ sum(1 << k for k in r.sample(range(64), d)) for b in base for d in (0, 1, 2, 3)})
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    forest = simhash.components(simhash.edges(spark.createDataFrame([(v,) for v in signed], "fp long"), len(x), 3, members))
    root = {r.node: r.root for r in forest.collect()}
    for a in range(len(x)):
        for b in range(a):
            if (x[a] ^ x[b]).bit_count() <= 3:
                assert root[signed[a]] == root[signed[b]]


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.stored(stage(spark, now, str(tmp_path)), f"t{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == now.columns and 0 < after.count() <= now.count()
        now = after
    assert set(now.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
