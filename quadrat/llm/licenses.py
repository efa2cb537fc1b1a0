"""License scan by sentence rules (native).

Texts are cut into pieces (lines, and sentences within lines) and normalised. A sentence of a rule is a piece, or as many
pieces as it is wrapped over: a single line end is a blank in it, also with comment marks before the next line, but a
blank line or a line that ends in . ! ? ; : ends it. A match needs all sentences of its rule in order and next to each
other, starts and ends with pieces, and gives way to a longer one that it lies within. Pieces that are the first words of
a rule find it in a broadcast of at most ``MAX_BROADCAST`` rows (counted first; a shuffled join beyond); the pieces from
there, no more than the rule has words, are then held against the whole rule. All other steps are narrow or grouped by
document row.

Defined results: null and empty texts match nothing; rows that repeat match each for itself; an empty table gives no
rows; texts of any length are scanned whole; other columns are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import common as C

MAX_BROADCAST = 100_000

#: Sentences of public licence notices. Rules are (license, rule, sentences in order).
TEXTS = (
    ("MIT", "mit-notice", ("Released under the MIT License.",)),
    ("MIT", "mit-notice-2", ("Licensed under the MIT License.",)),
    ("Apache-2.0", "apache-notice", ("Licensed under the Apache License, Version 2.0.",)),
    ("GPL-3.0", "gpl3-notice", ("This work is licensed under the GNU General Public License, version 3.",)),
    ("CC-BY-NC-4.0", "cc-by-nc-notice", ("Licensed under CC BY-NC 4.0.",)),
    ("CC-BY-4.0", "cc-by-notice", ("Licensed under CC BY 4.0.",)),
    ("CC-BY-SA-4.0", "cc-by-sa-notice", ("Licensed under CC BY-SA 4.0.",)),
    ("proprietary", "all-rights-notice", ("All rights reserved.",)),
    (
        "Apache-2.0",
        "apache-header",
        (
            'Licensed under the Apache License, Version 2.0 (the "License");',
            "you may not use this file except in compliance with the License.",
            "You may obtain a copy of the License at",
            "http://www.apache.org/licenses/LICENSE-2.0",
        ),
    ),
    (
        "MIT",
        "mit-text",
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ),
    ),
    ("MIT", "mit-notice-reserved", ("Released under the MIT License.", "All rights reserved.")),
    ("BSD-2-Clause", "bsd-2-text", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")),
    ("BSD-3-Clause", "bsd-3-text", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")),
    ("BSD-2-Clause", "bsd-2-text-numbered", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")),
    ("BSD-3-Clause", "bsd-3-text-numbered", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "3.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")),
    (
        "ISC",
        "isc-text",
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    ),
    ("0BSD", "0bsd-text", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",)),
    (
        "Unlicense",
        "unlicense-text",
        (
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ),
    ),
    (
        "Zlib",
        "zlib-text",
        (
            "This software is provided 'as-is', without any express or implied warranty.",
            "In no event will the authors be held liable for any damages arising from the use of this software.",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        ),
    ),
    ("BSL-1.0", "boost-header", ("Distributed under the Boost Software License, Version 1.0.",)),
    (
        "MPL-2.0",
        "mpl2-header",
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ),
    ),
    *(
        (
            f"{spdx}-or-later",
            f"{spdx.lower()}-header",
            (
                f"{it} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{semi} either version {version} of the License, or (at your option) any later version.",
                f"{it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            ),
        )
        for spdx, it, name, version, mark, semi in (
            ("GPL-2.0", "This program", "GNU General Public License", "2", ";", ";"),
            ("GPL-3.0", "This program", "GNU General Public License", "3", ":", ","),
            ("AGPL-3.0", "This program", "GNU Affero General Public License", "3", ":", ","),
            ("LGPL-2.1", "This library", "GNU Lesser General Public License", "2.1", ";", ";"),
            ("LGPL-3.0", "This library", "GNU Lesser General Public License", "3", ":", ","),
        )
    ),
)

#: Names that notices give to licences.
NAMES = (
    ("MIT", "the MIT License"),
    ("MIT", "the MIT license"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-2.0", "the Apache License 2.0"),
    ("Apache-2.0", "the Apache 2.0 License"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("BSD-3-Clause", "the 3-Clause BSD License"),
    ("ISC", "the ISC License"),
    ("Zlib", "the zlib License"),
    ("Unlicense", "the Unlicense"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("MPL-2.0", "the Mozilla Public License 2.0"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("EPL-2.0", "the Eclipse Public License 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-2.0", "the GNU General Public License v2.0"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("GPL-3.0", "the GNU General Public License v3.0"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
)
#: How notices begin.
NOTICES = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "This content is licensed under")


def rules() -> tuple[tuple[str, str, tuple[str, ...]], ...]:
    """TEXTS, a notice of each kind for each name, and the identifier line of each licence; no sentence twice. Sentences are cut as texts are."""
    cut = lambda said: tuple(x for y in said for x in re.split(r"(?<=[.!?;:])\s+", y))
    out, key = [(a, b, cut(c)) for a, b, c in TEXTS], lambda said: tuple(re.sub(r"[\W_]+", " ", x.lower()).strip() for x in said)
    known = {key(said) for _, _, said in out}
    every = [(spdx, f"{start} {name}.") for spdx, name in NAMES for start in NOTICES]
    for spdx, said in [*((a, (b,)) for a, b in every), *((a, ("SPDX-License-Identifier:", a)) for a in dict.fromkeys(x for x, *_ in (*NAMES, *TEXTS)) if a != "proprietary")]:
        if key(said) not in known:
            known.add(key(said))
            said = cut(said)
            out.append((spdx, "spdx-line" if len(said) > 1 else "-".join(key(said)[0].split()), said))
    return tuple((a, b if b != "spdx-line" else f"spdx-{a.lower()}", c) for a, b, c in out)


RULES = rules()


def pieces(text: Column) -> Column:
    """Texts cut at line ends and after . ! ? ; : before a blank, normalised, without empty ones. Each piece ends in "|", or in
    a line end where its sentence may go on in the next."""
    t = F.concat(F.translate(F.coalesce(text, F.lit("")), "\x01", "\x02"), F.lit("\x01"))
    t = F.regexp_replace(t, r"\n[^\p{L}\p{N}\n\x01]+", "\n")  # comment marks
    t = F.regexp_replace(t, r"""[.!?;:](?:[ \t\r\f]+|["')\]]*[ \t\r\f]*\n)|\n\n+""", "\x01")
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\n\x01]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \n\x01]*\x01[ \n\x01]*", "|"), r" *\n *", "\n")
    return F.filter(F.split(F.ltrim(t), r"(?<=[\n|])"), lambda p: F.length(p) > 1)


def normalised(sentence: Column) -> Column:
    """Lower case, with one blank for each run of other characters than letters, digits and inner points."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def rule_tables(spark, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(heads: norm, k for the first words of each rule, as many as a piece may have; rules: k, license, rule, n_said, n_words, pattern)."""
    known = spark.createDataFrame([(k, a, b, list(c)) for k, (a, b, c) in enumerate(rules)], "k long, license string, rule string, said array<string>")
    norms = F.transform("said", normalised)
    within = lambda s: F.replace(normalised(s), F.lit(" "), F.lit("[ \n]"))
    # a sentence without an end mark may be followed by the next one in the same piece
    ends = lambda s: F.when(s.rlike(r"[.!?;:]\s*$"), F.lit("[\n|]")).otherwise(F.lit("[ \n|]"))
    n = F.size("said")
    parts = F.transform("said", lambda s, i: F.concat(within(s), F.when(i == n - 1, F.lit("[\n|]")).otherwise(ends(s))))
    known = known.select("k", "license", "rule", n.cast("long").alias("n_said"), F.concat(F.lit("^"), F.array_join(parts, "")).alias("pattern"), F.split(F.array_join(norms, " "), " ").alias("_w"))
    heads = known.select("k", F.explode(F.transform("_w", lambda _, i: F.array_join(F.slice("_w", F.lit(1), i + 1), " "))).alias("norm"))
    return heads, known.select("k", "license", "rule", "n_said", F.size("_w").alias("n_words"), "pattern")


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, rule, first_sentence (the piece it starts with, from 0, empty ones not counted), n_sentences: a row for each match."""
    heads, known = rule_tables(docs.sparkSession, rules)
    small = len(rules) <= MAX_BROADCAST and heads.count() <= MAX_BROADCAST
    heads = heads.join(F.broadcast(known) if small else known, "k").drop("k")
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), pieces(F.col(text_col)).alias("_s"))
    starts = rows.select("_id", "_row", "_s", F.posexplode("_s").alias("at", "_p")).withColumn("norm", F.expr("left(_p, length(_p) - 1)"))
    if not small:  # no whole texts in the shuffle
        most = known.agg(F.max("n_words")).first()[0] or 0
        starts = starts.withColumn("_s", F.slice("_s", F.col("at") + 1, most))
    starts = starts.join(F.broadcast(heads) if small else heads, "norm")
    text = F.array_join(F.slice("_s", F.col("at") + 1 if small else F.lit(1), F.col("n_words")), "")
    found = starts.select("_id", "_row", "at", "license", "rule", "n_said", F.call_function("regexp_extract", text, F.col("pattern"), F.lit(0)).alias("_m")).where("_m <> ''")
    hit = F.struct("license", "rule", F.col("at").cast("long").alias("first_sentence"), F.col("n_said").alias("n_sentences"), F.length(F.regexp_replace("_m", r"[^\n|]", "")).cast("long").alias("n_pieces"))
    hits = found.groupBy("_row").agg(F.first("_id").alias("_id"), F.collect_list(hit).alias("hits"))
    end = lambda h: h["first_sentence"] + h["n_pieces"]
    within = lambda h, o: (o["n_pieces"] > h["n_pieces"]) & (o["first_sentence"] <= h["first_sentence"]) & (end(o) >= end(h))
    best = F.filter(F.col("hits"), lambda h: ~F.exists(F.col("hits"), lambda o: within(h, o)))
    return hits.select(F.col("_id").alias(id_col), F.inline(best)).drop("n_pieces")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    rules = ", ".join(f"({quote(a)}, {quote(b)}, {k}, {quote(s)})" for a, b, ss in RULES for k, s in enumerate(ss))
    return rf"""
WITH r AS (SELECT license, rule, k, {norm("s")} AS norm, count(*) OVER (PARTITION BY rule) AS n FROM (VALUES {rules}) AS v(license, rule, k, s)),
s AS (SELECT doc_id, unnest(x) AS norm, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(
      string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\r\f]+', '\1' || chr(10), 'g'), chr(10)), lambda y: {norm("y")}), lambda y: y <> '') AS x FROM documents)),
m AS (SELECT doc_id, license, rule, pos - k AS first_sentence, n AS n_sentences FROM s JOIN r USING (norm) GROUP BY ALL HAVING count(DISTINCT k) = n)
SELECT doc_id, license, rule, first_sentence::BIGINT AS first_sentence, n_sentences::BIGINT AS n_sentences FROM m AS a
WHERE NOT EXISTS (SELECT 1 FROM m AS b WHERE a.doc_id = b.doc_id AND b.n_sentences > a.n_sentences
      AND b.first_sentence <= a.first_sentence AND b.first_sentence + b.n_sentences >= a.first_sentence + a.n_sentences)"""
