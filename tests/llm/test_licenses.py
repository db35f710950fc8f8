import textwrap
from collections import Counter

from paperloom.llm import licenses as L

STRANGE = ["", None, "\n\n", "license", "Licensed under the Apache License, Version 2.0.\r\nAll rights reserved.", "zz " * 3000 + "released under the mit license", "RELEASED UNDER THE MIT LICENSE", "the public house"]


def run(spark, docs):
    return L.scan(docs).collect()


def test_templates_are_known_and_ordinary_sentences_are_not():
    for family, some in L.TEMPLATES.items():
        for text in some:
            assert L.expected(text) == [(0, family)], text
    for text in L.NO_LICENCE:
        assert all(f == L.UNKNOWN for _, f in L.expected(text)), text


def test_documents_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = run(spark, docs)
    assert Counter((r.doc_id, r.paragraph, r.family) for r in got) == Counter((r.doc_id, p, f) for r in rows for p, f in L.expected(r.text))
    assert all(0 <= r.probability <= 1 and 0 <= r.shared <= 1 for r in got)


def test_strange_texts(spark):
    rows = [(k, t, "x") for k, t in enumerate(STRANGE)] + [(5, STRANGE[5], "x"), (None, STRANGE[4], "x")]
    got = run(spark, spark.createDataFrame(rows, "doc_id long, text string, key string"))
    assert Counter((r.doc_id, r.paragraph, r.family) for r in got) == Counter((i, p, f) for i, t, _ in rows for p, f in L.expected(t))
    assert {(r.paragraph, r.family) for r in got if r.doc_id == 4} == {(0, "apache-2.0"), (1, "proprietary")}
    assert run(spark, spark.createDataFrame([], "doc_id long, text string")) == []


def test_changed_notices_hold(spark):
    text = "This work is now licensed under the Apache License, Version 2.0 by them."
    assert L.expected(text) == [(0, "apache-2.0")]
    p = L.train().probabilities(text)
    assert abs(p.sum() - 1) < 1e-9


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it\nunder the terms of the GNU Affero\nGeneral Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this\nsoftware for any purpose with or without fee\nis hereby granted, provided that the notice appears in all copies.",
}


def test_wrapped_notices(spark):
    texts = []
    for family, text in WRAPPED.items():
        assert [x for x in L.expected(text) if x[1] != L.UNKNOWN] == [(0, family)], text
        texts += [(family, 0, text), (family, 2, f"The river ran on and on\nuntil the sea\n{text}\nand so it went on."), (family, 3, f"zuon thea\r\nelle\r\n\r\n" + text.replace("\n", "\r\n"))]
        assert not any(f == family for _, f in L.expected(text.replace("\n", "\n\n"))), text  # blank lines part paragraphs
    got = run(spark, spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(texts)], "doc_id long, text string"))
    assert Counter((r.doc_id, r.paragraph, r.family) for r in got) == Counter((k, p, f) for k, (_, _, t) in enumerate(texts) for p, f in L.expected(t))
    for k, (family, at, _) in enumerate(texts):
        assert [(r.paragraph, r.family) for r in got if r.doc_id == k and r.family != L.UNKNOWN] == [(at, family)]


#: Notices and sentences that the classifier was not trained on; None: no licence is granted.
UNSEEN = {
 "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The project is distributed and licensed under the MIT License, see LICENSE.", "// SPDX-License-Identifier: MIT", "# Copyright (c) 2019 Foo. Licensed under the MIT license."],
 "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice.", "This module is released under the BSD License.", "Licensed under the 3-clause BSD license (see COPYING)."],
 "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should know that this work is licensed under the GNU General Public License, version 3 or later.", "licensed under the GNU GPL v3"],
 "lgpl": ["This library is free software and is licensed under the GNU Lesser General Public License, version 2.1 or later.", "Licensed under the GNU LGPL v3 only."],
 "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.", "Licensed under the GNU AGPL v3."],
 "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "This product is licensed under the Apache License, Version 2.0, by the authors.", "SPDX-License-Identifier: Apache-2.0"],
 "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears."],
 "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."],
 "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy."],
 "cc-by": ["The article is licensed under a Creative Commons Attribution 4.0 International License.", "Photos licensed under CC BY 4.0."],
 "cc-by-sa": ["Text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
 "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License, with thanks."],
 "cc0": ["To the extent possible under law, the person has waived all copyright and related or neighboring rights to this work."],
 "proprietary": ["Copyright 2021 Foo Inc. All rights reserved.", "Unauthorized copying of this file, via any medium is strictly prohibited."],
 None: ["This file is not released under the MIT License.", "The code was never licensed under the Apache License, Version 2.0.", "This work is not licensed under the GNU General Public License, version 3.", "Is it released under the BSD License or not?", "It is no longer licensed under CC BY 4.0.",
        "She renewed her driving license under the new law.", "MIT released a report on public records.", "The general public license office is open.", "We are not licensed under the MIT License.", "Not all rights are reserved here.", "Nothing here is released under the ISC License."],
}


def test_unseen_notices_and_denials():
    """On one line and wrapped at 72 and 40 columns: precision and recall of families, each at least 0.95."""
    hit = missed = wrong = 0
    for family, some in UNSEEN.items():
        for text in some:
            for wide in (10_000, 72, 40):
                got = {f for _, f in L.expected("\n".join(textwrap.wrap(text, wide))) if f != L.UNKNOWN}
                hit += family in got
                missed += family is not None and family not in got
                wrong += len(got - {family})
    print(f"hit {hit}, missed {missed}, wrong {wrong}")
    assert hit / (hit + wrong) >= 0.95 and hit / (hit + missed) >= 0.95


def test_probabilities_are_calibrated():
    """Over unseen single lines, the mean probability of what is said lies within 0.15 of how often it is right."""
    told = [(max(p), L.train().families[int(p.argmax())] == (family or L.UNKNOWN)) for family, some in UNSEEN.items() for text in some for p in [L.train().probabilities(text)]]
    sure, right = (sum(x) / len(told) for x in zip(*told, strict=True))
    assert abs(sure - right) <= 0.15, (sure, right)
