from tracewell.plans import corpus


def test_scores(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    put("one/a.c", "/* Copyright (c) 2001 Jane Doe */\n")
    put("one/a.c.yml", "what: [copyrights, holders]\ncopyrights:\n  - Copyright (c) 2001 Jane Doe\nholders:\n  - Jane Doe\n  - Nobody\n")
    put("two/b.c", "nothing\n")
    put("two/c.c.yml", "what: [copyrights]\n")
    pairs, counts = corpus.load_pairs(spark, str(tmp_path))
    assert tuple(counts.first()) == (1, 1, 1)
    got = {r["kind"]: (r["expected"], r["found"], r["right"], r["precision"], r["recall"]) for r in corpus.score_copyrights(pairs).collect()}
    assert got == {"copyright": (1, 1, 1, 1.0, 1.0), "holder": (2, 1, 1, 1.0, 0.5)}
