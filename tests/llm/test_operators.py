"""The operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tallyweave.llm import chat, language, neighbours, packing, passages, pieces, quality, simhash, substrings, tables, toxicity
from tallyweave.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long"
LABELS = "doc_id long, quality int, toxic int"


def prose(seed, n, words=("the", "of", "and", "stone", "river", "light", "house", "winter", "paper", "green")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(i, 120) for i in range(12)]
    passage = prose(99, 90)
    texts = [
        None, "", " \n\t", *base, base[0], base[0], base[1] + " end", "x" + base[2] + "\n" + passage,
        base[3][:300] + passage + base[4][:200], passage, "é" * 300 + passage + "é" * 90, "a" * 1000, prose(5, 6000),
    ]
    rows = [(i, t, "en", "s", 1, "clash", 2) for i, t in enumerate(texts)]
    rows += [rows[4], (None, base[5], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    foreign = ("der", "und", "straße", "wasser", "über", "licht", "baum", "haus")
    for i in range(240):
        german = i % 2
        text = prose(i, 60, foreign if german else ("the", "of", "stone", "river", "light", "house", "winter"))
        bad, toxic = i % 5 == 1, i % 7 == 1
        if bad:
            text = "### ".join(text.split()) + "$$$"
        if toxic:
            text = text.replace(" ", " blorgen ", 1)
        rows.append((i, text, "de" if german else "en", None, None, None, None))
        labels.append((i, 0 if bad else 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache(), spark.createDataFrame(labels, LABELS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)


def test_simhash_groups(docs, nothing):
    found = simhash.near_groups(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    fps = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            comp[i] = min(comp[j] for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 4)
    ids = {c: min((r.doc_id for r, d in zip(rows, comp) if d == c and r.doc_id is not None), default=None) for c in comp}
    key = lambda x: tuple(map(str, x))
    expected = sorted([(r.doc_id, f"{f:016x}", ids[c]) for r, f, c in zip(rows, fps, comp)], key=key)
    assert sorted(map(tuple, found), key=key) == expected
    assert simhash.near_groups(nothing[0]).count() == 0


@pytest.mark.parametrize(("segments", "block"), [(2, 1024), (3, 16)])
def test_simhash_links_of_hot_segment(spark, segments, block):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63, 40)}
    fps |= {sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 6), replace=False)) for _ in range(150)}
    fps = sorted(fps)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.near_links(table, 4, segments, block).collect()
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    assert all(near(a, b) for a, b in links)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def joined(pairs):
        for f in fps:
            root[f] = f
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(f) for f in fps]

    assert joined(links) == joined([(a, b) for a in fps for b in fps if a < b and near(a, b)])


def test_cut_repeats(docs, nothing):
    found = substrings.cut_repeats(docs)
    assert found.columns == [*docs.columns, "cut"]
    rows = found.collect()
    data = [(r.text or "").encode() for r in rows]
    seen = {}
    for d in data:
        for p in range(len(d) - 399):
            seen[d[p : p + 400]] = seen.get(d[p : p + 400], 0) + 1
    for r, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - 399):
            if seen[d[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        assert (r.cut.n_bytes, r.cut.n_removed, bytes(r.cut.kept)) == (len(d), int(gone.sum()), kept)
        assert len(r.cut.spans) == int((np.diff(gone.astype(int), prepend=0) == 1).sum())
    assert substrings.cut_repeats(nothing[0]).count() == 0


def test_suffix_dedup_starts_one_worker_a_task(docs, nothing):
    """Two Python functions in one task need two workers, and an executor keeps all workers it ever had."""
    import corpus_pipeline as own

    rows = docs.select(own.COLUMNS)
    # repeats that begin or end within a character
    cyrillic = [(200 + i, chr(0x430 + i) * 3 + "ж" * 200 + "абв"[i] * 9, None, None, None) for i in range(3)]
    cyrillic.append((300, "\u0416" * 200, None, None, None))
    rows = rows.union(docs.sparkSession.createDataFrame(cyrillic, rows.schema))
    found = own.suffix_dedup(docs.sparkSession, rows, "")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    cut = substrings.cut_repeats(rows, own.PASSAGE_BYTES).collect()
    expected = [r.text if not r.cut.n_removed else bytes(r.cut.kept).decode("utf-8", "ignore") for r in cut]
    assert any(r.cut.n_removed for r in cut) and any(r.text is None for r in cut)
    assert any(len(bytes(r.cut.kept)) > len(t.encode()) for r, t in zip(cut, expected) if t is not None and r.cut.n_removed)
    by_id = lambda rows: sorted(rows, key=repr)
    expected = [(r.doc_id, t, r.lang, r.source, None if t is None else len(t)) for r, t in zip(cut, expected)]
    assert by_id(map(tuple, found.collect())) == by_id(expected)
    assert own.suffix_dedup(docs.sparkSession, nothing[0], "").count() == 0


def test_stages_leave_no_texts_behind(labelled, tmp_path):
    """What a stage writes on the way stays on disk to the end; verdicts need no copy of the texts."""
    import corpus_pipeline as own

    rows, labels = labelled
    spark = rows.sparkSession
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    twice = rows.select(own.COLUMNS).limit(3)
    empty = spark.createDataFrame([(900, None, "de", None, None), (901, "", None, None, None), (None, "1 2", None, None, None)], twice.schema)
    rows = rows.select(own.COLUMNS).union(twice).union(empty).cache()
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    found = own.language_id(spark, rows, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, rows.exceptAll(empty).collect()), key=repr)
    kept = own.quality_rules(spark, rows, str(tmp_path))
    verdict = quality.with_verdict(rows, labels).where("kept").select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in verdict.collect())
    written = [spark.read.parquet(str(p)) for p in folder.iterdir() if p not in before]
    assert written and not any({"text", "row"} & set(w.columns) for w in written)


def test_packing(docs, nothing, tmp_path):
    path = str(tmp_path / "pieces")
    packing.token_pieces(docs, TOKENIZER).write.parquet(path)
    rows = packing.pack(docs.sparkSession.read.parquet(path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected += [(r.doc_id, k, a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.piece, r.start, zlib.crc32(r.ids))) for r in rows)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(r.length for r in rows) // 2048) + 1
    empty = str(tmp_path / "empty")
    packing.token_pieces(nothing[0], TOKENIZER).write.parquet(empty)
    assert packing.pack(docs.sparkSession.read.parquet(empty)).count() == 0


def test_plan_uses_every_rank_once():
    rng = random.Random(3)
    counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(30)}
    plan = packing.plan_places(counts, 64)
    used = {}
    for r in plan.itertuples():
        for rank in range(r.low, r.high):
            used.setdefault((r.length, rank), []).append((r.sequence + rank - r.low, r.offset))
    assert all(len(x) == 1 for x in used.values()) and len(used) == sum(counts.values())


def test_rule_counts_and_verdict(docs, labelled, nothing):
    assert quality.counts_of(None)[:5] == (0, 0, 0, 0, 0)
    text = "a b c d e f g h\nx\nx\n\n a b c d e f g h #$é"
    assert quality.counts_of(text)[:5] == (19, 21, 2, 1, 16)
    judged = quality.with_verdict(*labelled).join(labelled[1], "doc_id").collect()
    wrong = [r for r in judged if r.quality is not None and r.kept != (r.quality == 1)]
    assert len(wrong) <= 0.02 * len(judged) and not [r for r in wrong if r.quality == 0]
    assert quality.filtered(*labelled).columns == labelled[0].columns
    kept = {r.doc_id for r in quality.with_verdict(docs, nothing[1]).collect() if r.kept}
    assert 0 not in kept and 1 not in kept and 3 in kept
    assert quality.with_verdict(*nothing).count() == 0


def test_language(docs, labelled, nothing):
    model = language.learn(labelled[0], 60)
    found = language.with_language(labelled[0], model).collect()
    right = sum(r.language.lang_pred == r.lang for r in found)
    assert right >= 0.98 * len(found)
    other = {r.doc_id: r.language for r in language.with_language(docs, model).collect()}
    assert [other[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and other[None].score >= 0
    assert language.learn(nothing[0]) is None
    assert {r.language.lang_pred for r in language.with_language(docs, None).collect()} == {"und"}


def test_gradients_of_networks():
    rng = np.random.default_rng(0)
    net = language.ByteGru(["a", "b"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows, target = rng.integers(1, 5, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0])
    g, loss = net.gradients(windows, target)
    for name in g:
        at = (0,) * g[name].ndim if name != "table" else (0, int(windows[0, 0]), 1)
        net.weights[name][at] += 1e-3
        assert (net.gradients(windows, target)[1] - loss) / 1e-3 == pytest.approx(g[name][at], abs=2e-3)
        net.weights[name][at] -= 1e-3


def test_features_by_the_chunk_are_those_of_all():
    texts = [prose(i, 50_000) for i in range(6)] + ["", "é" * 700, prose(9, 30)]
    assert len(list(tables.chunks(texts))) > 1
    for found, whole in zip(passages.features_of(texts), passages.passages_of(texts), strict=True):
        assert np.array_equal(found, whole)


def test_classifiers(docs, labelled, nothing):
    for module, label, cut in ((passages, "quality", 0.3), (toxicity, "toxic", 0.5)):
        model = module.learn(*labelled)
        rows = labelled[0].join(labelled[1], "doc_id").withColumn("score", module.scored(model, labelled[0].text))
        rows = [r for r in rows.collect() if r[label] is not None]
        assert sum((r.score >= cut) == r[label] for r in rows) >= 0.95 * len(rows)
        scores = docs.withColumn("score", module.scored(model, docs.text)).collect()
        assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
        assert module.learn(*nothing) is None


def test_toxic_word_of_both_classes():
    texts = [prose(i, 40) + (" blorgen" if i < 15 or i == 20 else "") for i in range(120)]
    toxic = np.array([int(i < 15) for i in range(120)])
    machine = toxicity.train(texts, toxic, landmarks=60, negatives=60)
    insult, clean = machine.margins(["blorgen"])[0], machine.margins(sorted(set(" ".join(texts[15:20]).split())))
    assert insult > 0.5 and clean.max() < 0


def test_chat(spark):
    said = [(1, 0, "user", "hi"), (1, 1, "bot", "ho"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "ho")]
    said += [(3, 2, None, None), (4, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "user", "x")]
    table = spark.createDataFrame([(*r, 1) for r in said], "conv_id long, turn int, role string, text string, turns int")
    rows = {r.conv_id: (r.n_turns, r.rendered) for r in chat.maximal_conversations(table).collect()}
    assert rows == {3: (3, "<|user|>\nhi\n<|bot|>\nho\n<||>\n\n"), 4: (1, "<|user|>\nx\n")}
    assert chat.maximal_conversations(table.limit(0)).count() == 0


def test_chat_with_long_and_random_conversations(spark):
    """Against brute force: ties of turns, null turns, repeated rows, shared beginnings and 100,000 turns in one conversation."""
    rng = random.Random(11)
    told = {}
    for c in range(300):
        start = list(told[rng.randrange(c)]) if c and rng.random() < 0.6 else []
        more = [(rng.choice("ub"), rng.choice(["", "a", "b"])) for _ in range(rng.randrange(0 if start else 1, 4))]
        told[c] = start[: rng.randrange(len(start) + 1)] + more or start
    rows = [(c, i, r or None, t or None) for c, own in told.items() for i, (r, t) in enumerate(own)]
    rows += rng.sample(rows, 50) + [(900, 0, "u", "q"), (900, 0, "u", "p"), (901, 0, "u", "p"), (902, None, "u", "p"), (902, 1, "u", "q")]
    told |= {900: [("u", "p"), ("u", "q")], 901: [("u", "p")], 902: [("u", "p"), ("u", "q")]}
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    long = spark.range(200_000).select(
        F.expr("1000 + id % 2").alias("conv_id"), F.expr("int(id / 2)").alias("turn"), F.lit("u").alias("role"),
        F.when(F.col("id") < 199_999, F.expr("string(int(id / 2) % 7)")).otherwise("end").alias("text"),
    )
    found = {r.conv_id: (r.n_turns, r.rendered) for r in chat.maximal_conversations(table.unionByName(long)).collect()}
    least = {tuple(own): c for c, own in sorted(told.items(), reverse=True)}
    inner = {own[:i] for own in least for i in range(len(own))}
    want = {c: own for own, c in least.items() if own not in inner}
    assert found.pop(1000)[0] == found.pop(1001)[0] == 100_000
    assert found == {c: (len(own), "".join(f"<|{r}|>\n{t}\n" for r, t in own)) for c, own in want.items()}


def test_pieces(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in docs.collect() if r.text is not None] + ["  a  b\tc\n d ", "日本 語 🙂x", "aaaaaaaaaaaa", "1 23"]
    model = pieces.PieceModel(path)
    ids = model.encode(texts)
    assert ids == library.encode(texts)
    assert [model.decode(x) for x in ids] == texts
    null = docs.where("text is null").select(pieces.encoded(docs.text, path).alias("ids")).first().ids
    assert null is None
    assert docs.limit(0).select(pieces.encoded(docs.text, path)).count() == 0
    back = docs.withColumn("ids", pieces.encoded(docs.text, path)).withColumn("back", pieces.decoded(F.col("ids"), path))
    both = docs.select("text", pieces.encoded_and_checked(docs.text, path).alias("done")).select("text", "done.*")
    assert {(r.text, tuple(r.ids or ()), r.round_trip) for r in both.collect()} == {
        (r.text, tuple(r.ids or ()), None if r.text is None else r.back == r.text) for r in back.collect()
    }
    assert both.where("text is null and ids is null").count() == both.where("text is null").count() > 0
    assert back.count() == docs.count() and back.where(~F.col("back").eqNullSafe(F.col("text"))).count() == 0


def test_pieces_of_random_texts(monkeypatch):
    """Ids equal the library's, also if pairs of pieces keep driving one another out of their table."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    letters = "abcdefghijklmnop  ▁éüß日本😀\t\n0123.,'-ABĆ\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["ab" * 2000 + "😀" * 50]
    for bits in (4, pieces.PAIR_BITS):
        monkeypatch.setattr(pieces, "PAIR_BITS", bits)
        assert pieces.PieceModel(path).encode(texts) == library.encode(texts)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 16)).round(3)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (550, [0.0] * 16, 1), (600, [float("nan")] * 16, 1), (650, [None] * 16, 1), (700, [1.0], 1)]
    table = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>, rank int")
    found = neighbours.nearest(table, block_rows=100).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 50):
        own = sorted([r for r in found if r.query_id == q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        score = unit @ unit[q]
        score[q] = -2
        best = sorted(range(400), key=lambda i: (-round(score[i], 12), i))[:5]
        hits += len({r.vec_id for r in own} & set(best))
        assert all(abs(r.score - unit[r.vec_id] @ unit[q]) < 1e-12 for r in own)
    assert hits >= 36 and {r.query_id for r in found} == set(range(0, 400, 50))
    assert neighbours.nearest(table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 6, 500, 5000])
def test_neighbours_with_production_parameters(spark, n):
    vectors = np.random.default_rng(n).normal(size=(n, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(table).collect()
    assert len(found) == len({(r.query_id, r.vec_id) for r in found}) == len(range(0, n, 50)) * min(5, n - 1)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 50):
        score = unit @ unit[q]
        score[q] = -2
        hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(-score, kind="stable")[: min(5, n - 1)].tolist()))
    assert hits >= 0.95 * len(found)


def test_near_dedup_without_unique_ids(spark):
    import corpus_pipeline as own

    alone, one, other, copied, unnamed = (prose(i, 80) for i in range(50, 55))
    rows = [(None, alone), (1, one), (1, other), (2, copied), (None, copied), (3, copied), (None, unnamed), (None, unnamed)]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    wanted = sorted([(None, alone), (1, one), (1, other), (2, copied), (None, unnamed)], key=str)
    for parts in (1, 5):
        found = own.near_dedup(spark, table.repartition(parts), "").collect()
        assert sorted([(r.doc_id, r.text) for r in found], key=str) == wanted


def test_scaled_copies_tie_by_id(spark):
    """Every vector is one of 7 directions at some length: neighbours are the copies with the smallest ids."""
    rng = np.random.default_rng(3)
    ways = rng.normal(size=(7, 24))
    rows = [(i, (ways[i % 7] * float(rng.uniform(0.1, 900))).tolist()) for i in range(420)]
    rows += [(500, [1e250] * 24), (501, [3e251] * 24), (502, [1e-250] * 24)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q in range(0, 420, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [v for _, v, _ in own] == [v for v in range(q % 7, 420, 7) if v != q][:5]
        assert all(abs(c - 1) < 1e-12 for _, _, c in own)
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 500)[:2] == [(1, 501), (2, 502)]


@pytest.mark.parametrize("rows, parts, limit", [(0, 1, 5), (3, 2, 5), (40, 3, 5), (20_000, 40, 100)])
def test_least_hashed_is_a_sorted_limit(spark, rows, parts, limit):
    df = spark.range(0, rows, 1, parts)
    value = F.xxhash64("id", F.lit(7))
    got = [r.id for r in tables.least_hashed(df, limit, value, "id").collect()]
    assert got == [r.id for r in df.orderBy(value, "id").limit(limit).collect()]
    kept = df.where(tables.among_least(value, rows, limit)).count()
    assert kept <= 4 * limit + 128


def test_letters():
    assert [language.has_letter(t) for t in (None, "", "½²①Ⅷ 12_", "1a", "ß", "日", "\u0301")] == [
        False, False, False, True, True, True, False,
    ]


def test_least_language_score():
    p = np.array([[0.9, 0.1], [0.4, 0.6], [0.3, 0.7], [0.55, 0.45]])
    assert language.least_score(p, np.array([0, 1, 0, 0])) == (0.5 + 0.55) / 2
    assert language.least_score(np.ones((2, 1)), np.array([0, 0])) == 0.0
    assert language.least_score(p[:0], np.zeros(0, int)) == 0.0


def test_least_language_score_is_of_all_documents(spark):
    model = language.ByteGru(["a", "b"])
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    held = next(i for i in range(60) if not zlib.crc32(str(i).encode()) % 5)
    rows = [(i, "a", ("a", 0.9)) for i in ids[1:]]
    # least of all, though any sample of some documents may miss it; then rows that take no part
    rows += [(ids[0], "b", ("b", 0.7)), (ids[1], "a", ("b", 0.6)), (held, "a", ("a", 0.51)), (None, "a", ("a", 0.52)), (ids[2], None, ("a", 0.53))]
    found = spark.createDataFrame(rows, "doc_id long, lang string, language struct<lang_pred:string,score:double>")
    assert language.least_score_of_all(found, model) == (0.5 + 0.7) / 2
    assert language.least_score_of_all(found.where("doc_id is null"), model) == 0.0
    assert language.least_score_of_all(found, None) == 0.0


def test_fingerprints_take_little_memory():
    texts = [" ".join(f"w{i * 7 + j}" for j in range(300)) for i in range(600)]
    tracemalloc.start()
    try:
        simhash.fingerprints_of(texts)
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_pipeline_on_smallest_tables(spark):
    import corpus_pipeline as own

    rows = own.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} <= docs
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
