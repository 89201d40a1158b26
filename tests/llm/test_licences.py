import pytest

from trackfold.llm import licences


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark)


def test_held_out_variants(spark, model):
    rows = [(f, t) for f, t, held in licences.training_rows() if held]
    out = licences.with_licences(spark.createDataFrame(rows, "want string, text string"), model).selectExpr("want", "coalesce(get(licences, 0).family, 'unknown') got").collect()
    right = sum(r.want == r.got for r in out)
    assert right >= 0.95 * len(out)
    assert all(r.got == "unknown" for r in out if r.want == "unknown")


def test_lines_of_documents(spark, model):
    rows = [
        (1, "Some words.\nLicensed under the Apache License, Version 2.0.", "x"),
        (2, "This work is licensed under the GNU General Public License, version 3.", "x"),
        (3, "a\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "x"),
        (4, "the licence plate of my car\nApache helicopters", "x"),
        (5, None, None),
        (6, "", "x"),
        (7, "von mit der keit " * 20000 + "\nLICENSED UNDER CC BY-NC 4.0.", "x"),
        (7, "plain", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = [(r.doc_id, r.families, r.n_stated) for r in licences.licence_report(docs).orderBy("doc_id", "n_stated").collect()]
    assert got == [(1, "apache-2.0", 1), (2, "gpl", 1), (3, "cc-by-nc,mit", 2), (4, "", 0), (5, "", 0), (6, "", 0), (7, "", 0), (7, "cc-by-nc", 1)]
    assert licences.with_licences(docs, model).columns == docs.columns
    assert licences.licence_report(docs.limit(0)).count() == 0


def test_scores_equal_a_plain_restatement(spark, model):
    import math
    import re

    lines = [t for _, t, _ in licences.training_rows()][::7]
    out = licences.with_licences(spark.createDataFrame(list(enumerate(lines)), "n long, text string"), model).selectExpr("n", "get(licences, 0).probability p", "get(licences, 0).template_share s").collect()
    weight = {(g, k): w for g, k, w in model.weights}
    for r in out:
        w = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", lines[r.n].lower())
        grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        if not any(c in lines[r.n].lower() for c in licences.needed_words()):
            assert r.p is None
            continue
        logit = [(model.intercepts[k] + sum(weight.get((g, k), 0) for g in grams)) / model.temperature for k in range(len(model.classes))]
        p = [math.exp(x - max(logit)) for x in logit]
        assert abs(r.p - max(p) / sum(p)) < 1e-9


def test_plan_is_native(spark, model):
    plan = licences.with_licences(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Exchange"))


MIT = """MIT License

Copyright (c) 2021 Some Authors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""


def test_wrapped_notices_and_short_statements(spark):
    comment = "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in ("A file\n\n" + HEADER.format("")).split("\n")) + " */"
    rows = [
        (1, MIT, "mit"),
        (2, MIT[MIT.index("Permission") :], "mit"),
        (3, BSD, "bsd"),
        (4, HEADER.format(""), "gpl"),
        (5, HEADER.format("Lesser "), "lgpl"),
        (6, HEADER.format("Affero "), "agpl"),
        (7, comment, "gpl"),
        (8, comment.replace("\n", "\r\n"), "gpl"),
        (9, "Some prose\n" * 300 + BSD + "\n" + HEADER.format("") + "\n" + "more prose\n" * 300, "bsd,gpl"),
        (10, BSD + "\n\n" + MIT, "bsd,mit"),
        (11, APACHE, "apache-2.0"),
        (12, "This work is licensed under a Creative\nCommons Attribution 4.0\nInternational License", "cc-by"),
        (13, "MIT License", "mit"),
        (14, "License: MIT", "mit"),
        (15, "The licence\nof my\ncar and the Apache\nhelicopters, creative\nwriting", ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r.doc_id: r for r in licences.licence_report(docs).collect()}
    assert {k: r.families for k, r in got.items()} == {k: want for k, _, want in rows}
    assert [(got[k].n_stated, got[k].n_unknown) for k in (3, 4, 12, 13)] == [(1, 0)] * 4
    assert [got[k].n_stated for k in (1, 9, 10)] == [2, 2, 3]


def test_no_text_that_can_be_confirmed_lacks_the_needed_words():
    """For every template: the trigrams that can stand in a text without needed words are too few."""
    needed = licences.needed_words()
    assert "the" not in needed and len(needed) < 80
    for notice in (t for ts in licences.TEMPLATES.values() for t in ts):
        grams = licences._notice_grams(notice)
        without = [g for g in grams if not any(w in g for w in needed)]
        assert len(without) < licences.CONFIRM * len(grams), notice


def test_whole_result_equals_a_plain_restatement(spark, model):
    """Families of one-line paragraphs by the rule alone: the likeliest class, sure enough, confirmed by a template."""
    import math
    import re

    texts = [t for _, t, _ in licences.training_rows()][::11] + ["See the MIT page", "a gnu", "plain words", "reserved seats", "GNU General Public"]
    out = {r.doc_id: r.families for r in licences.licence_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    weight: dict = {}
    for g, k, w in model.weights:
        weight[g, k] = w
    for n, t in enumerate(texts):
        w = re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
        grams = {" ".join(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1)}
        logit = [(model.intercepts[k] + sum(weight.get((g, k), 0) for g in grams)) / model.temperature for k in range(len(model.classes))]
        p = [math.exp(x - max(logit)) for x in logit]
        k = p.index(max(p))
        family = model.classes[k]
        share = max((len(set(licences._notice_grams(x)) & grams) / len(licences._notice_grams(x)) for x in licences.TEMPLATES.get(family, [])), default=0)
        sure = family != licences.UNKNOWN and p[k] / sum(p) >= model.threshold and share >= licences.CONFIRM
        assert out[n] == (family if sure else ""), t
