"""The operators against brute force, exact round trips and held-out rows, on small and awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from newsreach.llm import ann, components, fingerprints, language, licenses, near_duplicates, packing, pieces, quality, similar_texts, toxicity, warc
from newsreach.llm.queries import PIECE_MODEL, WORD_BPE
from newsreach.llm.rows import table
from newsreach.sources.workspace import fresh_path

AWKWARD = [
    (1, "the cat sat on the mat", "en", "x"), (2, None, None, None), (3, "", "en", "y"), (None, "no id here at all", "en", "z"),
    (5, "the cat sat on the mat", "en", "x"), (5, "the cat sat on the mat", "en", "x"), (6, "12 34 !!", "de", "x"),
    (7, "wort " * 30000, "de", "x"), (8, "Ünïcode ▁ \U0001f600 text\twith\nbreaks", "fr", "x"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, repeated and very long texts, and extra columns named like the operators' own."""
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    extra = {c: F.lit(7) for c in ("score", "words", "fingerprint", "anchor", "component_id", "range", "place", "term", "sequence_id", "held_out", "label")}
    return rows.withColumns(extra)


@pytest.fixture(scope="module")
def docs(spark, tables):
    return table(spark, tables, "documents")


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(marks):
    """(doc_id, fingerprint) -> smallest doc_id reachable over links of up to two bits, by comparing all pairs."""
    parent = list(range(len(marks)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i][1] ^ marks[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    lowest = {}
    for i, (doc, _) in enumerate(marks):
        if doc is not None:
            lowest[root(i)] = min(doc, lowest.get(root(i), doc))
    return [lowest.get(root(i)) for i in range(len(marks))]


def test_simhash_links_equal_all_pairs(spark, docs, awkward):
    for rows in (docs, awkward):
        data = rows.select("doc_id", "text").collect()
        marks = [(r.doc_id, simhash(r.text)) for r in data]
        want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(marks, components_of(marks))), key=repr)
        assert sorted((tuple(r) for r in near_duplicates.near_duplicates(rows).collect()), key=repr) == want
    assert near_duplicates.near_duplicates(awkward.limit(0)).count() == 0


def test_every_close_pair_meets_at_an_anchor(spark, monkeypatch):
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for c in centre for _ in range(12)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    marks = [(s, s % (1 << 64)) for s in signed]
    want = dict(zip(signed, components_of(marks)))
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for hot in (4096, 1):  # the second deals every anchor with more than one home to several tasks
        monkeypatch.setattr(near_duplicates, "HOT_HOMES", hot)
        monkeypatch.setattr(near_duplicates, "HOT_ANCHORS", 1000 if hot > 1 else 10**9)
        found = {r.node: r.root for r in components.connected_components(near_duplicates.links(df)).collect()}
        assert {v: found.get(v, v) for v in signed} == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}


def test_packing_keeps_every_id_once(spark, docs, awkward):
    whole = Tokenizer.from_file(WORD_BPE)
    for rows in (docs, awkward):
        got = packing.pack(rows, WORD_BPE).collect()
        texts = rows.select("doc_id", "text").collect()
        want = sorted(((r.doc_id, np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")) for r in texts), key=lambda x: (str(x[0]), len(x[1])))
        pieces_of: dict = {}
        for r in got:
            pieces_of.setdefault(r.doc_id, []).append(r)
        for doc, ids in want:
            for start, crc in {(r.start, r.ids_crc32) for r in pieces_of[doc] if r.doc_tokens == len(ids)}:
                length = next(r.length for r in pieces_of[doc] if (r.start, r.ids_crc32) == (start, crc))
                assert crc == zlib.crc32(ids[start : start + length].tobytes())
        assert sum(r.length for r in got) == sum(len(ids) for _, ids in want)
        filled: dict = {}
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == filled.get(r.sequence_id, 0) and r.length > 0
            filled[r.sequence_id] = r.offset + r.length
        assert max(filled.values()) <= 4096
    assert packing.pack(awkward.limit(0), WORD_BPE).count() == 0
    assert all(sum(packing.cut(n)) == n for n in (1, 64, 65, 4095, 4096, 4097, 20000))


def test_quality_and_language_learn_and_score_anything(spark, tables, docs, awkward):
    model = quality.fit_from_labels(docs, table(spark, tables, "labels"))
    scored = quality.classify(docs, model).join(table(spark, tables, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.9 * len(scored)
    assert all(0 <= r.score <= 1 for r in quality.classify(awkward, model).collect()) and quality.classify(awkward, model).count() == len(AWKWARD)
    nothing = quality.fit(docs.limit(0).withColumn("quality", F.lit(1)))
    assert {r.score for r in quality.classify(awkward, nothing).collect()} == {0.5}
    tongues = language.fit_from_documents(docs)
    found = language.identify(docs, tongues).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.9 * len(found)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(awkward, tongues).collect()}
    assert odd[2] == odd[3] == odd[6] == ("und", 0.0) and odd[1][0] != "und"
    empty = language.fit_from_documents(docs.limit(0))
    assert {r.lang_pred for r in language.identify(awkward, empty).collect()} == {"und"}


@pytest.mark.parametrize("classes", [1, 2, 4, 7, 12])
def test_codewords_stay_apart(classes):
    code = language.codewords(classes)
    assert code.shape[0] == classes
    if classes > 2:
        assert min((code[i] != code[j]).sum() for i in range(classes) for j in range(i)) >= 2 ** (min(classes, 7) - 2) // (1 if classes <= 7 else 4)


def test_toxicity_folds_and_spares(spark, awkward):
    model = toxicity.ToxicityModel({toxicity.fold(w): 5.0 for w in ("idiot", "loser", "trash")}, np.array([-4.0, 2.0, 2.0]), ("trash can",))
    scores = model.scores(["you IDIOTS", "1d1ot", "l0ser", "іdiоt", "put it in the trash can", "videotrash", "", "a fine day"])
    assert (scores[:4] > 0.3).all() and (scores[4:] < 0.3).all()
    rows = [(i, f"word{i} idiot text" if i % 3 == 0 else f"word{i} fine text", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = toxicity.fit_from_labels(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert {r.doc_id for r in toxicity.classify(df, learned).where("predicted = 1").collect()} == {i for i in range(60) if i % 3 == 0}
    assert toxicity.classify(awkward, learned).count() == len(AWKWARD) and toxicity.classify(awkward.limit(0), learned).count() == 0
    # A pair of words that clean documents hold is spared, learned from the labels as well.
    terms = {toxicity.fold("idiot"): 3.0}
    spared = [(i, f"x{i} the clown fish swims", 0) for i in range(5)] + [(9, "you clown fool", 1), (10, "a clown fool", 1)]
    table_of = spark.createDataFrame(spared, "doc_id long, text string, toxic int")
    assert toxicity.learn_exceptions(table_of, {toxicity.fold("clown"): 3.0}, "text", "toxic") == (toxicity.fold("clown fish"), toxicity.fold("the clown"))
    assert toxicity.learn_exceptions(table_of.limit(0), terms, "text", "toxic") == ()


def plain_measure(model, text):
    """Sum of weights of a text by trying every term at every word start, the longest of each start."""
    folded = toxicity.fold(text)
    spared = [(i, i + len(p)) for p in map(toxicity.fold, model.exceptions) for i in range(len(folded)) if folded.startswith(p, i)]
    spared = [(a, b) for a, b in spared if not a or not folded[a - 1].isalnum()]
    total = 0.0
    for i in range(len(folded)):
        if not i or not folded[i - 1].isalnum():
            held = [t for t in model.weights if folded.startswith(t, i)]
            if held:
                term = max(held, key=len)
                total += 0.0 if any(a <= i and i + len(term) <= b for a, b in spared) else model.weights[term]
    return total, len(text.split())


def test_toxicity_equals_a_plain_matcher_and_catches_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit_from_labels(docs, labels)
    found = toxicity.classify(docs, model).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    toxic = [r.predicted for r in found if r.toxic == 1]
    clean = [r.predicted for r in found if r.toxic == 0]
    assert len(toxic) > 80 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    texts = [r.text or "" for r in docs.where("doc_id % 50 = 0").select("text").collect() if len(r.text or "") < 3000]
    got = model.measures(texts)
    for text, (total, words) in zip(texts, got):
        want = plain_measure(model, text)
        assert abs(total - want[0]) < 1e-9 and words == want[1]
    scores = 1 / (1 + np.exp(-(toxicity.inputs(got) @ model.curve)))
    assert np.allclose(scores, model.scores(texts))


def test_language_and_quality_scores_equal_plain_scorers(spark, docs, tables):
    """Scores from the models' weights, word by word and n-gram by n-gram."""
    from newsreach.llm.subwords import features

    texts = [r.text or "" for r in docs.limit(60).collect()] + ["", "a", "?", "Ünïcode ▁ 😀 text"]
    model = language.fit_from_documents(docs)
    frame = model.predict(texts)
    for text, row in zip(texts, frame.itertuples()):
        if not any(map(str.isalpha, text)):
            assert row.lang_pred == "und" and row.score == 0 and np.isnan(row.loss)
            continue
        words = language.words_of(text)
        margin = model.bias + np.mean([model.weights[features([w], language.SIZES, language.BITS, whole=False)[1]].mean(axis=0) for w in words], axis=0)
        loss = [(np.logaddexp(0, -margin * code) * model.trust).sum() for code in model.code]
        chance = np.exp(-np.array(loss))
        assert row.lang_pred == model.classes[int(np.argmin(loss))]
        assert abs(row.loss - min(loss)) < 1e-3 and abs(row.score - chance.max() / chance.sum()) < 1e-3
    scorer = quality.fit_from_labels(docs, table(spark, tables, "labels"))
    for text, score in zip(texts, scorer.scores(texts)):
        words = quality.words_of(text)
        mean = np.mean([scorer.weights[features([w], quality.SIZES, quality.BITS)[1]].mean() for w in words]) if words else 0.0
        assert abs(score - 1 / (1 + np.exp(-(mean + scorer.bias)))) < 1e-3


def test_language_stage_rejects_other_languages_and_keeps_known_ones(spark):
    folder = "/root/testdata/sf0.1"
    given = table(spark, folder, "documents")
    foreign = ["bu hava durumu hakkında türkçe bir metindir ve karlar ilkbaharda hızla erir " * 5, "if (x == 0) { return foo->bar[i]; } else { y += 3; } " * 9,
               "xkcdqz wvbgfq zzxkjq qxzjkwv bfgqxz jkwvbf gqxzjk " * 9, "", None, "12 34 !!"]
    extra = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(foreign)], "doc_id long, text string").withColumns(
        {c: F.lit(None).cast(t) for c, t in given.dtypes if c not in ("doc_id", "text")})
    kept = corpus_pipeline.language_filter(spark, given.unionByName(extra), folder)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [r.doc_id for r in given.where("text rlike '[a-z]{3}'").select("doc_id", language.held_out().alias("h")).collect() if r.h]
    assert not [i for i in ids if i < 0] and len([i for i in clean if i in ids]) >= 0.99 * len(clean)
    assert corpus_pipeline.language_filter(spark, given.limit(0), folder).count() == 0


def test_language_limits_rest_on_every_known_document(spark, monkeypatch):
    """The limits are the exact quantiles of all labelled documents that are not held out, short and long texts apart."""

    class Spelled:
        classes = ["en"]

        def predict(self, texts):
            import pandas as pd

            loss = [float(x.split()[-1]) if x else float("nan") for x in texts]
            return pd.DataFrame({"lang_pred": "en", "score": 1.0, "ambiguous": False, "loss": loss})

    rng = np.random.default_rng(3)
    losses = [*rng.lognormal(size=14000).round(9).tolist(), 1e9, 1e9]
    short = [i % 5 == 0 for i in range(len(losses))]
    rows = [(i, f"{'w ' * (3 if s else 30)}{x!r}", "en" if i < 14000 else None) for i, (x, s) in enumerate(zip(losses, short))]
    given = spark.createDataFrame([*rows, (None, None, "en"), (-1, "", None)], "doc_id long, text string, lang string")
    known = [i for i in range(14000) if zlib.crc32(str(i).encode()) % 4 != 2]
    limits = {s: np.quantile([losses[i] for i in known if short[i] == s], language.WITHIN) for s in (False, True)}
    limits[True] = max(limits.values())
    monkeypatch.setattr(language, "fit_from_documents", lambda docs: Spelled())
    kept = corpus_pipeline.language_filter(spark, given, "")
    assert kept.columns == given.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, x in enumerate(losses) if x <= limits[short[i]]]


def test_stages_stand_awkward_and_empty_tables(spark, tables, awkward):
    docs = awkward.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).count() == 0, name
        out = stage(spark, docs, tables)
        assert out.count() > 0 if name != "language" else out.count() >= 0, name
        if name != "packing":
            assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
    empty = awkward.limit(0)
    assert quality.classify(empty, quality.fit_from_labels(empty, table(spark, tables, "labels"))).count() == 0
    assert language.identify(empty, language.fit_from_documents(empty)).count() == 0
    assert licenses.scan(empty).count() == 0 and pieces.digests(empty, PIECE_MODEL).count() == 0


def test_fingerprints_edit_and_search(spark, docs, awkward):
    for rows in (docs, awkward):
        data = sorted(rows.select("doc_id", "text").collect(), key=lambda r: (-(r.doc_id if r.doc_id is not None else -1), r.text or ""))
        texts = [r.text or "" for r in data]
        want = []
        for i, text in enumerate(texts):
            half, after = len(text) // 2, texts[(i + 1) % len(texts)]
            want.append((data[i].doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
        got = fingerprints.compared(rows).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
        marks = [int(r.fingerprint, 16) for r in got]
        for r, mark in zip(got, marks):
            near = sum(bin(mark ^ other).count("1") <= 3 for other in marks) - 1
            assert r.n_near == (near if r.doc_id is not None and r.doc_id % 100 == 0 else None)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text: dict = {}
    for doc, mark in [(r.doc_id, r.fingerprint) for r in got]:
        by_text.setdefault(next(t or "" for d, t, *_ in AWKWARD if d == doc), set()).add(mark)
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.compared(awkward.limit(0)).count() == 0


def test_license_places_equal_a_plain_scan(spark, docs, awkward):
    more = spark.createDataFrame([(20, "By cc by CC-BY the GNU  general public license; the apache License version 2.0 MIT license cc by nc"), (21, "cc by cc by")], "doc_id long, text string")
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans(licenses.UPPER, licenses.LOWER)
    for rows in (docs, awkward, more):
        want = []
        for r in rows.select("doc_id", "text").collect():
            words = word.findall((r.text or "").translate(low))
            places, labels, base = [], set(), set()
            for t in licenses.TEMPLATES:
                key = t.key.split()
                found = [i for i in range(len(words)) if words[i : i + len(key)] == key]
                labels |= {t.label} if found else set()
                base |= {t.label} if found and t.base else set()
                places += found if t.base else []
            want.append((r.doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))))
        got = [tuple(r)[:7] for r in licenses.scan(rows).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pieces_take_the_best_path_and_come_back(spark, docs, awkward):
    coder = pieces.Coder(pieces.Vocabulary(PIECE_MODEL))
    score = {p: s for p, s, n in zip(coder.vocabulary.pieces, coder.vocabulary.scores, coder.vocabulary.normal) if n}

    def best(marked):
        value = [0.0] + [float("-inf")] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(end):
                if marked[start:end] in score:
                    value[end] = max(value[end], value[start] + score[marked[start:end]])
            if marked[end - 1] not in score:
                value[end] = max(value[end], value[end - 1] + coder.unknown_score)
        return value[-1]

    for text in ("the quick brown fox", "  two  spaces ", "é x\ny", "Die ententebest ", "a\U0001f600b", "日本語"):
        ids = np.frombuffer(coder.encode(text), "<u4")
        assert coder.decode(ids) == text
        normal = [i for i in ids if coder.vocabulary.normal[i]]
        strange = sum(c not in coder.single for c in text.replace(" ", "▁"))
        assert sum(coder.vocabulary.scores[i] for i in normal) + strange * coder.unknown_score == pytest.approx(best("▁" + text.replace(" ", "▁")))
    assert all(r.round_trip for r in pieces.digests(docs, PIECE_MODEL).collect())
    odd = {r.doc_id: r for r in pieces.digests(awkward, PIECE_MODEL).collect()}
    assert odd[2].n_tokens == odd[3].n_tokens == 0 and not odd[8].round_trip and odd[7].round_trip
    ids = docs.select("text", pieces.encode_column(docs, PIECE_MODEL).alias("ids"))
    assert ids.select("text", pieces.decode_column(docs, PIECE_MODEL).alias("back")).where("text <> back").count() == 0


def test_warc_round_trip_with_small_ranges_and_false_magics(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i} y", "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(40000)) if i % 5 else "same") for i in range(1, 30)]
    rows += [(30, None, None), (31, "u", ""), (None, "u", "same"), (None, "v", "alone"), (25, "again", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        path = fresh_path(spark, "warc-test")
        warc.write(df, path)
        got = [r for r in warc.read(spark, path).collect() if r.record_type != "warcinfo"]
        responses = {r.record_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
        assert len(got) == len(rows)
        assert responses == {f"<urn:page:{i}>": h for i, _, h in rows if i and h and h != "same"} | {"<urn:page:25>": "same", "<urn:page:31>": "", "<urn:page:none>": "alone"}
        found = warc.round_trip(df).collect()
        copies = [(r.page_id, r.record_type, r.refers_to) for r in found if r.payload_bytes == 4]
        want = [(i, "revisit", 25) for i in (5, 10, 15, 20, None)] + [(25, "response", None)] * 2
        assert sorted(copies, key=repr) == sorted(want, key=repr)
        assert {r.payload_digest for r in found if r.page_id == 5} == {warc.base32_sha1(b"same")}
        assert warc.round_trip(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_magic_inside_a_member_is_no_border(spark, tmp_path):
    body = bytes(range(256)) * 20 + warc.MAGIC + b"tail" + warc.MAGIC * 3
    raw = [warc.record("response", f"<urn:page:{i}>", b"HTTP/1.1 200 OK\r\n\r\n" + body, "application/http") for i in range(40)]
    data = b""
    for x in raw:
        stored = zlib.compressobj(0, zlib.DEFLATED, 31)
        data += stored.compress(x) + stored.flush()
    (tmp_path / "a.warc").write_bytes(data)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        for size in ("7k", "31k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read(spark, str(tmp_path)).collect()
            assert sorted(r.record_id for r in got) == sorted(f"<urn:page:{i}>" for i in range(40)) and all(bytes(r.payload) == body for r in got)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_graph_search_finds_what_brute_force_finds(spark, tables):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    vectors[50:90] = vectors[50]  # a crowd of copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (None, [1.0] * 8), (60, rows[60][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got: dict = {}
    for r in ann.nearest(df, shard_rows=150).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    exact = vectors.astype(np.float64)
    assert set(got) == set(range(0, 400, 20))
    for query, found in got.items():
        scores = exact @ exact[query]
        scores[query] = -np.inf
        want = np.lexsort((np.arange(400), -np.round(scores, 10)))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and query not in {f[1] for f in found}
        assert np.allclose([f[2] for f in found], scores[[f[1] for f in found]])
        hits += len({f[1] for f in found} & set(want.tolist()))
        total += 20
    assert hits >= 0.95 * total
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(table(spark, tables, "embeddings")).count() > 0


def test_pipeline_keeps_columns_and_one_of_each_group(spark, tables, docs):
    current = docs.withColumn("component_id", F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, tables)
        assert out.columns == current.columns, name
        assert out.count() <= current.count() and out.exceptAll(current).count() == 0
        current = out
    kept = [(r.doc_id, simhash(r.text)) for r in current.collect()]
    assert components_of(kept) == [d for d, _ in kept]
    repeated = docs.union(docs.limit(3))
    assert corpus_pipeline.near_duplicate_filter(spark, repeated, tables).count() == corpus_pipeline.near_duplicate_filter(spark, docs, tables).count()
    assert corpus_pipeline.run(spark, tables).columns == [x.split()[0] for x in packing.PIECES.split(", ")]


def test_pipeline_removes_near_copies_by_exact_shingle_similarity(spark, tables):
    """Kept texts against brute-force Jaccard similarity of five-word shingles, over all pairs."""
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(words))
        for edits in range(1, 9):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    # A crowd of edits of one short text, most of them below the similarity of each other.
    words = [f"v{x}" for x in range(24)]
    for _ in range(120):
        copy = list(words)
        for at in rng.sample(range(24), rng.randrange(1, 3)):
            copy[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += ["a b c", "A  b c", "a b d", "one two three four five", None, ""]
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    name = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and name[i] != name[j]:
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if x == old else x for x in name]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_filter(spark, rows, tables).collect())
    assert kept == sorted(set(name)) and 12 < len(kept) < len(texts) - 30
    assert similar_texts.similar_texts(rows.limit(0)).count() == 0


def test_rare_shingle_pairs_are_all_pairs_at_the_similarity_and_grow_with_the_crowd(spark):
    rng = random.Random(9)
    words, counted = [f"v{x}" for x in range(24)], []
    for size in (100, 400):
        texts = set()
        while len(texts) < size:
            copy = list(words)
            for at in rng.sample(range(24), 2):
                copy[at] = f"y{rng.randrange(10**6)}"
            texts.add(" ".join(copy))
        texts = sorted(texts)
        rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
        sets = similar_texts.sets_of(rows, 5)
        pairs = {tuple(r) for r in similar_texts.rare_pairs(rows.select("key", F.col("key").alias("root")), sets, 0.8).collect()}
        plain = [set(similar_texts.shingles(x).tolist()) for x in texts]
        for i in range(size):
            for j in range(i + 1, size):
                assert len(plain[i] & plain[j]) < 0.8 * len(plain[i] | plain[j]) or (i, j) in pairs
        counted.append(len(pairs))
    assert counted[1] <= 40 * 4


def test_near_duplicate_stage_keeps_rows_not_ids(spark, tables):
    """Different texts without doc_id or under one doc_id all stay; copies go whatever their doc_id."""
    other = [" ".join(f"{x}{i}" for i in range(20)) for x in "abcdef"]
    data = [(None, other[0], 1), (None, other[1], 2), (None, other[2], 3), (5, other[3], 4), (5, other[4], 5), (6, other[5], 6), (7, other[5], 7),
            (None, other[5], 8), (None, other[1], 9), (6, other[5] + " ", 10)]
    rows = spark.createDataFrame(data, "doc_id long, text string, key int").withColumns({c: F.lit(1) for c in ("root", "count", "id", "kept", "value")})
    kept = corpus_pipeline.near_duplicate_filter(spark, rows, tables)
    assert kept.columns == rows.columns
    found = sorted(((r.doc_id, r.text.strip()) for r in kept.collect()), key=repr)
    assert found == sorted([(None, other[0]), (None, other[1]), (None, other[2]), (5, other[3]), (5, other[4]), (6, other[5])], key=repr)
    assert corpus_pipeline.near_duplicate_filter(spark, rows.limit(0), tables).count() == 0


def test_graph_search_scores_doubles_as_they_are(spark):
    """Vectors that are equal as floats are told apart, and several shards find what comparing all pairs finds."""
    rows = [(i, [1.0 + i * 1e-12, 0.5]) for i in range(30)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=3).collect()
    want = {q: [i for i in range(29, -1, -1) if i != q][:3] for q in (0, 10, 20)}
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want} == want
    assert all(r.score == (1 + r.query_id * 1e-12) * (1 + r.vec_id * 1e-12) + 0.25 for r in got)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    table_of = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(table_of, every=20, k=20, shard_rows=300).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 1200, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.95 * 60 * 20


def test_near_duplicate_stage_compares_what_simhash_links(spark, tables, monkeypatch):
    """Texts whose fingerprints differ in at most 2 bits are candidates whatever the bands say; texts without words are not."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    words = [f"w{i * i % 997}" for i in range(900)]
    texts = [" ".join(words), " ".join([*words[:-1], "o0"]), " ".join(reversed(words)), "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = similar_texts.marked_rows(rows, 5)
    prints = {r.doc_id: r.fingerprint for r in marked.collect()}
    assert 0 < ((prints[0] ^ prints[1]) % 2**64).bit_count() <= 2 < ((prints[0] ^ prints[2]) % 2**64).bit_count()
    value = {r.key: r.value for r in similar_texts.simhash_values(marked).collect()}
    key = {r.doc_id: r.key for r in marked.collect()}
    assert value[key[0]] == value[key[1]] != value[key[2]] and len(value) == 3
    without_bands = marked.withColumn("values", F.array(F.col("doc_id")))
    monkeypatch.setattr(similar_texts, "marked_rows", lambda docs, width: without_bands)
    kept = corpus_pipeline.near_duplicate_filter(spark, rows.where("doc_id < 3"), tables)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_fitting_holds_few_rows_of_weights_at_once():
    """Means of the words of a step equal those taken at once, without a row of weights for every feature in memory."""
    import tracemalloc

    from newsreach.llm.subwords import word_means

    rng = np.random.default_rng(4)
    count = rng.integers(1, 40, 20_000)
    weights, bucket = rng.normal(size=(1 << 12, 8)), rng.integers(0, 1 << 12, count.sum()).astype(np.int32)
    tracemalloc.start()
    found = word_means(weights, bucket, count)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, np.add.reduceat(weights[bucket], np.cumsum(count) - count, axis=0) / count[:, None])
    assert peak < bucket.size * 8 * 8 / 2
    assert word_means(weights, bucket[:0], count[:0]).shape == (0, 8)
