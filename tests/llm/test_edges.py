"""Every operator over odd rows, over no rows, and with columns that clash."""

import corpus_pipeline
from maskforge.llm import bpe, decontaminate, langid, line_dedup, near_dedup, quality, secrets, token_counts, toxicity, url_filter


def test_bpe(odd, none):
    source = bpe.default_vocabulary()
    back = bpe.decode(bpe.encode(odd, source), source, name="back").collect()
    assert len(back) == 13 and all(r["back"] == (r["text"] or "") for r in back)
    assert bpe.encode(none, source).count() == 0


def test_near_dedup(odd, none):
    for k in (2, 5):
        rows = near_dedup.near_duplicates(odd, k=k).collect()
        assert len(rows) == 13
        by = {r["doc_id"]: r for r in rows}
        assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[6]["kept"]
        assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["component_id"] == 1
        assert by[4]["n_shingles"] == 1 and by[None]["component_id"] is None and by[None]["kept"]
    assert near_dedup.near_duplicates(none).count() == 0


def test_toxicity(odd, none, labels):
    for docs, marks in ((odd, labels), (odd, labels.where("false")), (none, labels)):
        rows = toxicity.scored(docs, toxicity.fit(docs, marks)).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_langid(odd, none):
    rows = langid.identified(odd, langid.learn(odd)).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert len(rows) == 13 and by[1] == by[2] == by[3] == "und"
    assert {r["lang_pred"] for r in langid.identified(odd, langid.learn(none)).collect()} == {"und"}


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTPS://M.Free-Bets.example.org"), (5, "x://example.com/en/?a"), (6, "x://www.example.com/en/x#y"), (7, "x://EXAMPLE.net/es/"), (7, "x://EXAMPLE.net/es/")]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("m.free-bets.example.org", "", None, "block"),
        5: ("example.com", "/en/", "example.com/en/", "block"), 6: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 7: ("example.net", "/es/", "net/es/", "block"),
    }
    assert url_filter.judged(pages.where("false")).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "same words stand here once and again in this", "x"), (3, "same words stand here once and again in this plain text", "x")], "item_id long, text string, doc_id string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, items).collect()} == {(6, 3), (7, 3)}
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(odd, items.where("false")).count() == 0


def test_quality(spark, odd, none):
    rows = quality.judged(odd).collect()
    assert len(rows) == 13 and {r["doc_id"]: r["n_words"] for r in rows}[1] == 0
    assert {r["doc_id"]: r["n_dup_lines"] for r in rows}[10] == 39
    assert quality.judged(none).count() == 0
    clash = odd.withColumns({c: odd.text for c in ("n_words", "host", "lines", "_row", "lost", "base_failed")})
    assert sorted(map(str, quality.judged(clash).collect())) == sorted(map(str, rows))
    some = spark.createDataFrame([(i, f"line {i} of its own\ncopyright of the host", "a") for i in range(30)] + [(99, "copyright of the host", "b")], "doc_id long, text string, source string")
    lost = {r["doc_id"]: r["lost"] for r in quality.judged(some).collect()}
    assert lost[99] == 0.0 and all(lost[i] > 0 for i in range(30))


def test_secrets(odd, none):
    rows = secrets.scanned(odd).collect()
    assert len(rows) == 13 and all(r["n_assign"] == r["n_access"] == 0 for r in rows)
    assert all(r["base_spans"] == [] for r in rows if r["doc_id"] in (1, 2, 3))
    assert secrets.scanned(none).count() == 0


def test_line_dedup(spark, odd, none):
    out = line_dedup.deduplicated(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))  # nothing of 50 words repeats but in equal rows, which are one document
    assert line_dedup.deduplicated(none).count() == 0
    passage = "\n".join(f"line {i} of a passage that stands in many documents" for i in range(8))
    rows = [(3, f"own\n{passage}"), (1, f"{passage}\nend"), (None, passage), (7, None), (3, f"own\n{passage}"), (4, "x"), (5, f"a\n{passage}\n\n{passage}")]
    got = [(r["doc_id"], r["text"]) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, f"{passage}\nend"), (3, "own"), (3, "own"), (4, "x"), (5, "a\n"), (7, None)], key=repr)


def test_near_dedup_stage_of_repeated_ids(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "a"), (2, f"{words} more", "a"), (5, "some text of its own", "b"), (5, "another text under the id", "b"), (5, "some text of its own", "b"), (None, words, "a"), (None, words, "a"), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, near_dedup.stage_near_dedup(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, words, "a"), (5, "another text under the id", "b"), (None, words, "a"), (None, words, "a"), (6, None, None)], key=repr)


def test_token_counts(spark, odd, none, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    counts = token_counts.counted(odd.withColumn("tokenizer", odd.text).withColumn("n_tokens", odd.text), "words-2")
    assert rollup.apply("a", token_counts.inserts(counts)) and not rollup.apply("a", token_counts.inserts(counts))
    assert rollup.apply("none", token_counts.inserts(token_counts.counted(none, "words-2")))
    assert rollup.totals().agg({"n_docs": "sum"}).first()[0] == 13
    assert rollup.apply("b", token_counts.deletes(counts.where("doc_id = 6")))
    assert rollup.totals().agg({"n_docs": "sum"}).first()[0] == 11
    assert rollup.apply("c", token_counts.revisions(counts.where("doc_id = 7"), counts.where("doc_id = 7").replace("b", "z", "source")))
    before = sorted(rollup.totals().collect(), key=repr)
    rollup.compact()
    assert sorted(rollup.totals().collect(), key=repr) == before and not rollup.apply("a", token_counts.inserts(counts))
    assert any(r["source"] == "z" for r in before)


def test_pipeline_keeps_columns(spark, odd, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() < 200 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"]
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.columns == [c for c in odd.columns if c != "ids"] + ["ids", "n_tokens"]
        assert all(r["n_tokens"] == len(r["ids"]) and (r["ids"] == []) == (not r["text"]) for r in last.collect())
