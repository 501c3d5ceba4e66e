import random

from docwarden.catalog import SPACE
from docwarden.functions.hashing import chunk_sums, dense_vector, hashed_scores, sparse_sums, term_codes
from docwarden.functions.text import compact, piece_substring, pieces, terms
from docwarden.operators import detect, models, nlp, retrieval
from pyspark.sql import functions as F

PARAGRAPH = (
    "This public paragraph is about office events. "
    "Confidential pricing strategy and password handling must be reviewed. "
    "The final paragraph discusses lunch planning."
)


def test_chunks_cover_the_text(docs):
    rng = random.Random(3)
    texts = ["", " ", "a", *("".join(rng.choice("ab \u00e9\n.") for _ in range(n))
                              for n in (59, 60, 61, 110, 500, 899, 900, 901, 1680, 1681, 5000))]
    for size, overlap in ((900, 120), (60, 10), (10, 30), (7, 7)):
        rows = nlp.chunk_text(docs(*texts), size, overlap).orderBy("doc_id", "chunk_no").collect()
        for i, text in enumerate(texts):
            flat = " ".join(text.split())
            cut = [r.text for r in rows if r.doc_id == i]
            assert all(c and len(c) <= size and c == c.strip() and c in flat for c in cut)
            at = 0
            for c in cut:  # in order, and no word character between two chunks is lost
                begin = flat.index(c, max(0, at - overlap - 2))
                assert not flat[at:begin].strip()
                at = max(at, begin + len(c))
            assert not flat[at:].strip()
            if overlap < size < len(flat):
                assert abs(len(cut) - (len(flat) - overlap) / (size - overlap)) <= 1
            elif len(flat) <= size:
                assert cut == ([flat] if flat else [])


def test_chunk_values(docs):
    rows = nlp.chunk_text(docs("abcdefghij"), 4, 1).orderBy("chunk_no").collect()
    assert [r.text for r in rows] == ["abcd", "defg", "ghij"]


def test_hash_vector(docs):
    """Unit length, one component per distinct word, blind to word order and case."""
    texts = [PARAGRAPH, " ".join(reversed(PARAGRAPH.upper().split())), "password", "of it", "password password"]
    rows = docs(*texts).select("doc_id", dense_vector(terms(F.col("text"))).alias("v")).collect()
    v = {r.doc_id: r.v for r in rows}
    assert all(len(x) == 128 for x in v.values())
    assert all(abs(sum(c * c for c in v[i]) - 1) < 1e-12 for i in (0, 1, 2, 4))
    assert max(abs(a - b) for a, b in zip(v[0], v[1])) < 1e-12
    assert v[2] == v[4] and sorted(map(abs, v[2]))[-2:] == [0.0, 1.0]
    assert not any(v[3])


def test_retrieval_ranks_chunks(spark, sf, docs):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    cut = {}
    for r in nlp.chunk_text(source).collect():
        cut.setdefault(r.doc_id, []).append(r.text)
    for query in ("sensitive data compliance", "the and what", ""):
        for r in retrieval.retrieve(source, query, 4).select("doc_id", "context").collect():
            scores = [c.score for c in r.context]
            assert len(r.context) <= 4 and all(c.text in cut[r.doc_id] for c in r.context)
            assert len(r.context) == len({c.chunk_no for c in r.context})
            if any(s > 0 for s in scores):
                assert scores == sorted(scores, reverse=True) and min(scores) > 0
            else:  # nothing related: the first chunks
                assert [c.text for c in r.context] == cut[r.doc_id][:4]
    small = retrieval.retrieve(docs(PARAGRAPH), "pricing password compliance", 1, 60, 10).first()
    assert [c.text for c in small.context] == ["idential pricing strategy and password handling must be revi"]


def test_question_evidence_uses_each_question(spark, docs):
    asked = spark.createDataFrame([(1, 0, "lunch planning"), (2, 0, "office events")],
                                  "question_id bigint, doc_id bigint, question string")
    text = "Lunch planning is today. " + "x " * 900 + "The office events follow. " + "y " * 900
    rows = retrieval.question_evidence(asked, docs(text)).collect()
    best = {r.question_id: r.text.lower() for r in rows if r["rank"] == 1}
    assert "lunch planning" in best[1] and "office events" in best[2]
    for q in (1, 2):
        ranks = sorted(r["rank"] for r in rows if r.question_id == q)
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 3


def test_vector_topk_is_exact(spark, sf):
    import numpy as np

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr(
        "label AS collection", "vec_id", "embedding")
    got = retrieval.vector_topk(vectors, retrieval.centroids(vectors, 64), 3).collect()
    pdf = vectors.toPandas()
    for label, group in pdf.groupby("collection"):
        m = np.stack(group.embedding.to_numpy()).astype(float)
        c = m.mean(axis=0)
        score = m @ c / (np.linalg.norm(m, axis=1) * np.linalg.norm(c))
        best = group.vec_id.to_numpy()[np.argsort(-score, kind="stable")[:3]]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.collection == label] == list(best)


def test_vector_topk_with_several_queries(spark):
    vectors = spark.createDataFrame(
        [(c, v, [float(v % 3), float(v // 3), 1.0]) for c in (0, 1) for v in range(9)],
        "collection int, vec_id int, embedding array<double>")
    queries = spark.createDataFrame(
        [(0, 7, [1.0, 0.0, 0.0]), (0, 8, [0.0, 1.0, 0.0]), (1, 7, [0.0, 0.0, 1.0])],
        "collection int, query_id int, query array<double>")
    got = {(r.collection, r.query_id, r["rank"]): r.vec_id for r in retrieval.vector_topk(vectors, queries, 1).collect()}
    assert got == {(0, 7, 1): 2, (0, 8, 1): 6, (1, 7, 1): 0}


def test_pieces_cut_long_texts(spark):
    text = "".join(chr(97 + i % 26) for i in range(100)) + "é𝔘x" * 20
    df = spark.createDataFrame([(text,)], "t string").withColumn("c", pieces(F.col("t"), 16))
    for start, length in ((0, 5), (15, 2), (16, 16), (31, 40), (100, 60), (159, 1), (10, 0)):
        got = df.select(piece_substring(F.col("c"), F.lit(start), F.lit(length), 16).alias("s")).first().s
        assert got == text[start:start + length]


def test_sentence_chunks_keep_whole_sentences(docs):
    text = " ".join(f"Sentence {i} has exactly six words." for i in range(30)) + " " + "w " * 60 + "end."
    rows = nlp.chunk_sentences(docs(text), 20, 6).orderBy("chunk_no").collect()
    assert rows[0].text.endswith("2 has exactly six words.")
    assert rows[1].text.startswith("Sentence 2 has")
    assert all(len(r.text.split()) <= 20 for r in rows[:-1])
    assert rows[-1].text.endswith("end.")


def test_ruler_and_keyword_signals(docs):
    d = docs("Confidential token, TOKEN token; tokens non-confidential internal  use only")
    ruler = [(r.label, r.text, r["count"]) for r in nlp.ruler_signals(d).orderBy("row_no").collect()]
    assert ruler == [("SECRET", "token", 2), ("CONFIDENTIAL", "Confidential", 1),
                     ("SECRET", "TOKEN", 1), ("CONFIDENTIAL", "confidential", 1)]
    words = {r.text: r["count"] for r in nlp.keyword_signals(d).collect()}
    assert words == {"confidential": 2, "token": 4}


def test_semantic_signals(spark):
    scored = spark.createDataFrame(
        [(0, list("abcdefg"), ["0.9", "x", "0.8", "0.7", "0.6", "0.5", "0.4"]), (1, [], [])],
        "doc_id bigint, labels array<string>, scores array<string>")
    rows = {r.doc_id: r for r in nlp.semantic_signals(scored).collect()}
    assert rows[0].semantic_labels == list("acdef") and rows[0].nlp_status == "Enhanced NLP"
    assert rows[1].nlp_status == "Standard NLP"


def test_scorer_hook(docs):
    def scorer(frames):
        for f in frames:
            yield f[["doc_id"]].assign(labels=[["personal data"]] * len(f),
                                       scores=[[str(len(t))] for t in f.model_input])

    rows = nlp.semantic_signals(nlp.run_scorer(docs("abc", "x" * 5000), scorer)).orderBy("doc_id").collect()
    assert [r.signals[0].score for r in rows] == [3.0, 3000.0]


#: Answers of several models and the merged answer, worked out by hand.
ANSWERS = [
    (["Sensitive data and compliance risk were detected.", "Remediation should include redaction and access review."],
     "Sensitive data and compliance risk were detected.\n\nAdditional useful detail: "
     "Remediation should include redaction and access review."),
    (["same text.", "SAME text!", "  same, text "], "same text."),
    (["", "!!", "only one"], "only one"),
    (["aaaa bbbb cccc dddd risk. eeee ffff gggg. hhhh iiii jjjj kkkk.",
      "eeee ffff gggg. llll mmmm nnnn. oooo pppp llll. qqqq rrrr ssss tttt. uuuu vvvv wwww.",
      "llll mmmm nnnn. xxxx yyyy zzzz aaab."],
     "aaaa bbbb cccc dddd risk. eeee ffff gggg. hhhh iiii jjjj kkkk.\n\nAdditional useful detail: "
     "llll mmmm nnnn. qqqq rrrr ssss tttt."),
    (["risk privacy short", "risk privacy a bit longer text"], "risk privacy a bit longer text"),
    (["???"], None),
]


def test_merge_answers(spark, sf):
    rows = [(i, m, a) for i, (answers, _) in enumerate(ANSWERS) for m, a in enumerate(answers)]
    schema = "analysis_id bigint, model_no bigint, answer string"
    got = {r.analysis_id: r.answer
           for r in models.merge_answers(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: merged for i, (_, merged) in enumerate(ANSWERS) if merged is not None}
    turns = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "conv_id AS analysis_id", "turn AS model_no", "text AS answer")
    given = {}
    for r in turns.collect():
        given.setdefault(r.analysis_id, []).append(r.answer)
    got = {r.analysis_id: r.answer for r in models.merge_answers(turns).collect()}
    assert set(got) == set(given)
    for k, merged in got.items():  # one answer whole, then at most two sentences of the others
        base, _, more = merged.partition("\n\nAdditional useful detail: ")
        assert any(base == a or base == a.rstrip() for a in given[k])
        assert not more or all(s in " ".join(given[k]) for s in more.split(". ")[:1])


def test_parse_model_json(spark):
    ok = '{"Compliance observations": ["a", " ", "b"], "Security risks": "one", "Suggested remediation steps": {"x": 1}}'
    replies = spark.createDataFrame(
        [(0, f"Sure!\n```json\n{ok}\n```"), (1, "no json"), (2, "[1, 2]"), (3, '{"Security risks": [1, true]}')],
        "id int, reply string")
    rows = {r.id: [s["items"] for s in r.sections] for r in models.parse_model_json(replies).collect()}
    assert rows[0] == [["a", "b"], ["one"], []]
    assert rows[1] == [None, None, None]
    assert rows[3][1][0] == "1" and rows[3][0] == []


def test_merge_summaries_keeps_model_order(spark):
    items = [(0, "S", m, p, t) for m, texts in enumerate(
        [["First!", "second", "  "], ["FIRST", "third", "fourth", "fifth", "sixth"]])
        for p, t in enumerate(texts)]
    row = models.merge_summaries(spark.createDataFrame(
        items, "analysis_id int, section string, model_no int, pos int, item string")).first()
    assert row["items"] == ["First!", "second", "third", "fourth", "fifth"]


def test_prompts_hold_no_raw_values(docs):
    from docwarden.operators import detect, risk

    prepared = models.prepare_context(risk.assess(detect.scan(docs("PAN ABCDE1234F a@b.com nda"))))
    prompt = models.build_summary_prompt(prepared).first().prompt
    asked = models.build_question_prompt(prepared.withColumn("question", F.lit("why?"))).first().prompt
    for text in (prompt, asked):
        assert "ABCDE1234F" not in text and "[REDACTED PAN NUMBER]" in text and "[Section 1]" in text
    assert asked.startswith("Question: why?")


def test_fallback_statuses(spark):
    df = spark.createDataFrame([("m", True, None), ("", True, "boom"), (None, True, None), ("m", False, None)],
                               "model string, enabled boolean, error string")
    rows = df.select(models.choose_output(F.col("model"), F.lit("rules"), F.col("enabled"), F.col("error")).alias("c")).collect()
    assert [(r.c.output, r.c.status) for r in rows] == [
        ("m", "Enhanced analysis"), ("rules", "Rules fallback (boom)"),
        ("rules", "Rules fallback (No configured model returned a response.)"),
        ("rules", "Standard analysis")]


def test_vector_blocks_give_the_same_lists(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(("a", "b")[i > 100], i, rng.normal(size=4).round(1).tolist()) for i in range(140)]
    rows += [("a", 200, [0.0] * 4), ("a", 201, None), ("b", 202, [1.0, None, 0.0, 0.0]), ("b", 203, [1.0, 2.0]), ("c", 1, [1.0])]
    vectors = spark.createDataFrame(rows, "collection string, vec_id bigint, embedding array<double>")
    queries = vectors.where("vec_id % 7 = 0").selectExpr("collection", "vec_id AS query_id", "embedding AS query")

    def lists(k):
        return sorted(tuple(r) for r in retrieval.vector_topk(vectors, queries, k).collect())

    whole = lists(5)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    assert lists(5) == whole
    by_hand = []
    for c, q, x in rows:
        if q % 7 or x is None or None in x:
            continue
        near = []
        for d, v, y in rows:
            if d == c and y is not None and None not in y and len(y) == len(x):
                size = np.linalg.norm(x) * np.linalg.norm(y)
                near.append((-round(float(np.dot(x, y) / size), 9) if size else 0.0, v))
        by_hand += [(c, q, v, rank) for rank, (_, v) in enumerate(sorted(near)[:5], 1)]
    assert [(c, q, v, rank) for c, q, v, _, rank in whole] == sorted(by_hand, key=lambda r: (r[0], r[1], r[2]))


def test_model_windows_decide_every_place_once():
    text = "x" * 1050
    for window, overlap in ((100, 20), (1000, 100), (2000, 100), (51, 50)):
        cover = []
        for at, piece, low, high in detect.model_windows(text, window, overlap):
            assert piece == text[at: at + window] and at <= low and high <= at + len(piece)
            cover.append((low, high))
        assert cover[0][0] == 0 and cover[-1][1] == len(text)
        assert all(a[1] == b[0] for a, b in zip(cover, cover[1:]))
    assert [w[1] for w in detect.model_windows("")] == [""]


def test_free_entities_overlap_nothing():
    import random

    rng = random.Random(2)
    for _ in range(200):
        taken = [(s, s + rng.randrange(1, 6)) for s in rng.sample(range(60), 6)]
        entities = [("ORG", "v", s, s + rng.randrange(1, 8)) for s in (rng.randrange(70) for _ in range(20))]
        kept, spans = [], list(taken)
        for e in entities:
            if not any(e[2] < b and e[3] > a for a, b in spans):
                kept.append(e)
                spans.append((e[2], e[3]))
        assert list(detect.free_entities(entities, taken)) == kept


def test_model_entities_in_long_texts(spark, docs):
    def load():
        import re

        return lambda t: [("ORG", m[0], m.start(), m.end()) for m in re.finditer(r"\b[A-Z]{4,}\b|\bpdf\b|\bOK\b", t)]

    filler = "word " * 500
    text = f"ACME {filler}a@b.com {filler}GLOBEX pdf OK {filler} INITECH"
    scans = detect.scan(docs(text, "", "mail SHOUT@x.org"))
    for window, overlap in ((100_000, 2_000), (300, 40)):
        got = detect.with_model_entities(scans, load, window, overlap)
        rows = detect.explode_findings(got, "doc_id").orderBy("doc_id", "start").collect()
        assert [(r.doc_id, r.value) for r in rows] == [
            (0, "ACME"), (0, "a@b.com"), (0, "GLOBEX"), (0, "INITECH"), (2, "SHOUT@x.org")]
        assert all(text[r.start: r.end] == r.value for r in rows if r.doc_id == 0)
        assert got.columns == scans.columns


def test_chunk_sums_and_scores_equal_those_of_one_text(spark):
    lists = [["alpha beta beta the_end", "", "ab c1", "é alpha2 été"], [], None, ["the " * 500], ["x"] * 9_000 + ["beta alpha"]]
    rows = spark.createDataFrame(
        [(i, t, ["alpha", "beta", "alpha"] if i % 2 == 0 else []) for i, t in enumerate(lists)],
        "i int, t array<string>, q array<string>").repartition(1)
    got = rows.select("i", chunk_sums(F.col("t")).alias("sums"), hashed_scores(F.col("t"), F.col("q")).alias("scores"))
    found = {r.i: (r.sums, r.scores) for r in got.collect()}
    assert found[2] == (None, None) and found[1] == ([], [])
    one = rows.where("t IS NOT NULL").select("i", "q", F.posexplode("t").alias("at", "x")).where("at < 4 OR at = 9000")
    dot = F.aggregate(F.arrays_zip(dense_vector(terms(F.col("x"))).alias("a"), dense_vector(F.col("q")).alias("b")),
                      F.lit(0.0), lambda a, z: a + z["a"] * z["b"])
    shared = F.size(F.array_intersect("q", terms(F.col("x")))) / F.greatest(F.size(F.array_distinct("q")), F.lit(1))
    for r in one.select("i", "at", sparse_sums(term_codes(terms(F.col("x")))).alias("s"), (dot + shared).alias("score")).collect():
        assert found[r.i][0][r.at] == r.s
        assert abs(found[r.i][1][r.at] - r.score) < 1e-12


def test_chunks_are_hashed_over_arrow_batches(spark, docs):
    for rows in (retrieval.hash_vectors(docs("alpha beta")), retrieval.retrieve(docs("alpha beta"))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_compact_leaves_single_spaces_alone(spark):
    texts = [" a  b ", "a b", "\ta\n\nb", "a \u00a0b\x1c c", "  ", "", "\u2028", "a\u3000 b \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.btrim(F.regexp_replace("t", f"[{SPACE}]+", " "), F.lit(" "))
    assert rows.where(compact(F.col("t")) != plain).isEmpty()
