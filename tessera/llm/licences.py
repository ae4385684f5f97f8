"""Licence scans: Dice coefficient of word bigrams between text and licence templates.

DataFrame functions only.  A text's units are normalised to words of ``[a-z0-9]``.
With ``a`` and ``b`` distinct bigrams, a Dice coefficient of ``t`` needs
``b * t / (2 - t) <= a <= b * (2 - t) / t``; so a unit is compared only with the
templates that its size admits.  It also needs ``b * t / (2 - t)`` shared bigrams
at least, so only so many of the template's words can be absent (each word that
is takes its bigrams away): documents without enough words of any template are
left out before their units are made.

Units are lines and paragraphs, for notices, and *passages* for whole licence
texts, which run over several paragraphs: runs of lines most of whose words are the
template's, blank lines between them included.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

# Notices that refer to a licence, and whole texts of short licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}


#: Whole texts without their copyright lines; Apache-2.0 is its notice for source files, which takes three paragraphs.
TEXTS: dict[str, str] = {
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "0BSD": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "BSD-3-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
""",
    "BSL-1.0": """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "Unlicense": """
This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>
""",
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
""",
}


def words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def _bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def least_words(bigrams_: list[str], threshold: float) -> int:
    """How many of a template's words a unit with the coefficient must hold.

    A bigram has two words, so absent words take away half the sum of their
    bigrams' numbers at least; the words with the fewest bigrams can be absent most cheaply.
    """
    pairs = [b.split(" ") for b in bigrams_]
    degree = sorted(sum(w in p for p in pairs) for w in {w for p in pairs for w in p})
    spare, absent = 2 * (len(pairs) - ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)), 0
    for d in degree:
        spare -= d
        if spare < 0:
            break
        absent += 1
    return len(degree) - absent


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _passages(lines: Column, vocabulary: Column) -> Column:
    """``(unit_no, w)`` of the runs of lines (arrays of words) three fifths of whose words are in the vocabulary; blank lines don't end a run."""
    run = "struct<unit_no:bigint,w:array<string>>"
    none = F.expr("cast(null as bigint)")
    empty = F.struct(F.expr(f"cast(array() as array<{run}>)").alias("done"), none.alias("no"), F.expr("cast(array() as array<string>)").alias("w"))

    def step(acc: Column, line: Column) -> Column:
        held = F.size(acc["w"]) > 0
        mine = F.size(F.filter(line["w"], lambda x: F.array_contains(vocabulary, x))) * 5 >= F.size(line["w"]) * 3
        done = F.when(held, F.concat(acc["done"], F.array(F.struct(acc["no"].alias("unit_no"), acc["w"].alias("w"))))).otherwise(acc["done"])
        return (
            F.when(F.size(line["w"]) == 0, acc)
            .when(mine, F.struct(acc["done"].alias("done"), F.when(held, acc["no"]).otherwise(line["unit_no"]).alias("no"), F.concat(acc["w"], line["w"]).alias("w")))
            .otherwise(F.struct(done.alias("done"), none.alias("no"), F.expr("cast(array() as array<string>)").alias("w")))
        )

    finish = lambda acc: F.when(F.size(acc["w"]) > 0, F.concat(acc["done"], F.array(F.struct(acc["no"].alias("unit_no"), acc["w"].alias("w"))))).otherwise(acc["done"])
    return F.aggregate(lines, empty, step, finish)


def scan(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] | None = None,
    texts: dict[str, str] | None = None,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, unit, unit_no, licence, template, shared, dice)``: the best template of each unit at ``threshold`` or more.

    ``unit`` is ``line`` (numbered from 0 over all lines), ``paragraph`` (of
    several lines, numbered over all paragraphs) or ``passage`` (numbered by its
    first line).  Lines and paragraphs are compared with ``templates``, passages with
    ``texts``, whose ``template`` number is that after the licence's last template.
    Ties go to the first licence in the alphabet, then to the first template.
    A null or empty text has no unit; a template or unit of one word has no bigram
    and matches nothing; rows with one id, or without one, are one document; long
    texts are scanned whole; an empty table gives an empty result; other columns
    are not read, so their names can't clash.
    """
    templates, texts = TEMPLATES if templates is None else templates, TEXTS if texts is None else texts
    rows, sizes, needed = [], [], []
    every = [(licence, k, t, "short") for licence, ts in sorted(templates.items()) for k, t in enumerate(ts)]
    every += [(licence, len(templates.get(licence, ())), t, "whole") for licence, t in sorted(texts.items())]
    for licence, k, t, kind in every:
        if b := bigrams(t):
            rows.append((kind, licence, k, b, len(b)))
            low, high = ceil(len(b) * threshold / (2 - threshold) - 1e-9), floor(len(b) * (2 - threshold) / threshold + 1e-9)
            sizes += [(n, len(rows) - 1) for n in range(max(1, low), high + 1)]
            needed.append((kind, sorted(set(words(t))), least_words(b, threshold)))
    bounds = {}
    for kind in ("short", "whole"):
        own = [n for n, k in sizes if rows[k][0] == kind]
        bounds[kind] = (min(own), max(own)) if own else (1, 0)
    text = F.coalesce(F.col("text"), F.lit(""))
    able = lambda ws, n: F.size(F.array_intersect(F.col("known"), _strings(ws))) >= n

    def any_of(kind: str) -> Column:
        out = F.lit(False)
        for of, ws, n in needed:
            out = out | able(ws, n) if of == kind else out
        return out

    def units_of(name: str, parts: Column) -> Column:
        return F.transform(
            parts,
            lambda x, i: F.struct(F.lit("short").alias("kind"), F.lit(name).alias("unit"), i.cast("long").alias("unit_no"), let(F.split(_norm(x), " "), _bigrams).alias("b")),
        )

    none = F.expr("cast(array() as array<struct<kind:string,unit:string,unit_no:bigint,b:array<string>>>)")
    # numbered before single lines are left out
    several = F.transform(F.split(text, "\n[ \t]*\n"), lambda x: F.when(F.contains(x, F.lit("\n")), x).otherwise(F.lit("")))
    short = F.when(any_of("short"), F.concat(units_of("line", F.split(text, "\n")), units_of("paragraph", several))).otherwise(none)
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.cast("long").alias("unit_no"), F.filter(F.split(_norm(x), " "), lambda w: w != "").alias("w")))
    whole = none
    for kind, ws, n in needed:
        if kind == "whole":
            found = F.transform(_passages(lines, _strings(ws)), lambda r: F.struct(F.lit("whole").alias("kind"), F.lit("passage").alias("unit"), r["unit_no"].alias("unit_no"), _bigrams(r["w"]).alias("b")))
            whole = F.concat(whole, F.when(able(ws, n), found).otherwise(none))
    fits = lambda u: F.size(u["b"]).between(*bounds["short"]) & (u["kind"] == "short") | F.size(u["b"]).between(*bounds["whole"]) & (u["kind"] == "whole")
    vocabulary = sorted({w for _, ws, _ in needed for w in ws})
    units = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("known", F.array_intersect(F.split(_norm(text), " "), _strings(vocabulary)) if vocabulary else F.array().cast("array<string>"))
        # the outer form keeps the optimizer from computing the array again to test that it isn't empty
        .select("doc_id", F.explode_outer(F.filter(F.concat(short, whole), fits)).alias("u"))
        .where("u is not null")
        .select("doc_id", "u.*", F.size("u.b").alias("n"))
    )
    # templates by the sizes that they admit: a small table, fixed by the templates and not by the data
    spark = docs.sparkSession
    admitted = spark.createDataFrame([(n, *rows[k]) for n, k in sizes], "n int, kind string, licence string, template int, tb array<string>, m int")
    matched = (
        units.join(F.broadcast(admitted), ["n", "kind"])
        .withColumn("shared", F.size(F.array_intersect("b", "tb")))
        .withColumn("dice", 2.0 * F.col("shared") / (F.col("n") + F.col("m")))
        .where(F.col("dice") >= threshold)
    )
    key = F.struct((-F.col("dice")).alias("d"), "licence", "template", "shared", "dice")
    return (
        matched.groupBy("doc_id", "unit", "unit_no")
        .agg(F.min(key).alias("x"))
        .select("doc_id", "unit", "unit_no", "x.licence", F.col("x.template").cast("long").alias("template"), F.col("x.shared").cast("long").alias("shared"), "x.dice")
    )
