"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A text becomes its sequence of five-word shingle hashes. Windows are as long as twice a class of template lengths (powers of
two) and overlap by half, so each place where a template of the class may stand lies whole in a window. A window of 2 * c
shingles that holds at least 75 of 100 of a template's n shingles (c / 2 < n <= c) shares s >= 0.75 * n of at most
n + 2 * c - s shingles with it: a similarity of 0.75 * n / (0.25 * n + 2 * c) at least, 0.176 where n is just above c / 2.
With BANDS bands of one minimum each, the chance that no band agrees is (1 - 0.176) ** BANDS at most: 4e-6 for 64.
Everything on the way is a Spark expression; the templates are a fixed table, so broadcasting them is bounded.

A band can only agree where a template's own shingle of least hash stands in the text. So texts without any of those
shingles, and windows without one, are left out before windows are made: no candidate is lost by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import table

WORDS, PERCENT, BANDS = 5, 75, 64

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
    "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
    "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
    "as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
    "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom "
    "the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this "
    "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
    "derivative works are solely in the form of machine-executable object code generated by a source language processor."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
    "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
    "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
    "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
    "copyright law."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/."
)


def _gnu(name: str, version: str, thing: str = "program") -> str:
    """The notice by which the GNU licenses are applied to a work."""
    return (
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version "
        f"{version} of the License, or (at your option) any later version. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {thing}."
    )


#: Public license texts, the standard notices of longer licenses, and short lines by which texts name one.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-line": "This project is licensed under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": _MIT,
    "BSD-2-Clause-text": _BSD_TERMS + _BSD_DISCLAIMER,
    "BSD-3-Clause-text": _BSD_TERMS + _BSD_THIRD + _BSD_DISCLAIMER,
    "BSD-disclaimer": _BSD_DISCLAIMER,
    "ISC-text": _ISC,
    "Zlib-text": _ZLIB,
    "BSL-1.0-text": _BOOST,
    "Unlicense-text": _UNLICENSE,
    "Apache-2.0-notice": _APACHE,
    "MPL-2.0-notice": _MPL,
    "GPL-2.0-notice": _gnu("GNU General Public License", "2"),
    "GPL-3.0-notice": _gnu("GNU General Public License", "3"),
    "LGPL-2.1-notice": _gnu("GNU Lesser General Public License", "2.1", "library"),
    "LGPL-3.0-notice": _gnu("GNU Lesser General Public License", "3"),
    "AGPL-3.0-notice": _gnu("GNU Affero General Public License", "3"),
}


def _hashes(docs: DataFrame) -> DataFrame:
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")
    w = F.col("__w")
    out = docs.withColumn("__w", words)
    h = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WORDS - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WORDS)]))
    return out.withColumn("h", h)


def band(window: Column, k: Column) -> Column:
    """The k-th band: the shingle whose hash under function k is least, by that hash."""
    return F.array_min(F.transform(window, lambda x: F.xxhash64(x, k)))


def templates(spark) -> DataFrame:
    """license_id, t (distinct shingles), class: the smallest power of two not below their number."""
    rows = spark.createDataFrame(sorted(TEMPLATES.items()), "license_id string, text string")
    rows = _hashes(rows).select("license_id", F.array_distinct("h").alias("t"))
    return rows.withColumn("class", F.pow(F.lit(2), F.ceil(F.log2(F.size("t").cast("double")))).cast("int"))


def scan(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text -> doc_id, license_id, containment (part of the template's shingles that the best window holds),
    first_shingle (where that window starts) and n_windows (windows that hold the template): a row for each license
    found in a document. Null, empty and short texts hold none. A repeated doc_id, null included, is scanned row by row and
    its finds are joined. Texts of any length are read whole, and give windows only where a template's shingle stands.
    An empty table gives an empty one; other columns are left out."""
    ship(docs.sparkSession)
    known = templates(docs.sparkSession)
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1))
    banded = known.select("license_id", "t", "class", F.explode(bands).alias("k")).withColumn("value", band(F.col("t"), F.col("k")))
    # a fixed number of longs: the shingles that can decide a band
    decides = F.filter("t", lambda x: F.xxhash64(x, F.col("k")) == band(F.col("t"), F.col("k")))
    chosen = known.select("class", "t", F.explode(bands).alias("k")).select("class", F.explode(decides).alias("x"))
    deciding: dict[int, set[int]] = {}
    for r in chosen.distinct().collect():
        deciding.setdefault(r["class"], set()).add(r["x"])
    every = sorted(set().union(*deciding.values()))

    def windows(size: int) -> Column:
        """Windows [j * size, j * size + 2 * size) with a deciding shingle: a run of size shingles lies whole in one."""
        mine = F.filter("__at", lambda p: p["x"].isin(*sorted(deciding[size])))
        js = F.flatten(F.transform(mine, lambda p: F.array(F.floor(p["i"] / size), F.greatest(F.floor(p["i"] / size) - 1, F.lit(0)))))
        return F.transform(F.array_distinct(js), lambda j: F.struct(F.lit(size).alias("class"), (j * size).cast("int").alias("start")))

    # texts without windows leave at the explode. A filter on h would be pushed below it and hash every text twice
    at = F.filter(F.transform("h", lambda x, i: F.when(x.isin(*every), F.struct(x.alias("x"), i.alias("i")))), lambda p: p.isNotNull())
    rows = _hashes(docs.select("doc_id", "text")).select("doc_id", "h").withColumn("__at", at)
    rows = rows.select("doc_id", "h", F.explode(F.concat(*[windows(c) for c in sorted(deciding)])).alias("w"))
    rows = rows.select("doc_id", "w.class", "w.start", F.slice("h", F.col("w.start") + 1, 2 * F.col("w.class")).alias("window"))
    own = F.transform(bands, lambda k: F.struct(k.alias("k"), band(F.col("window"), k).alias("value")))
    rows = rows.select("doc_id", "class", "start", "window", F.explode(own).alias("b")).select("doc_id", "class", "start", "window", "b.k", "b.value")
    hits = rows.join(F.broadcast(banded), ["class", "k", "value"])
    shared = F.size(F.array_intersect("t", "window"))
    found = hits.filter(shared * 100 >= percent * F.size("t")).withColumn("containment", shared / F.size("t"))
    best = F.max_by(F.col("start"), F.struct(F.col("containment"), -F.col("start")))
    return found.groupBy("doc_id", "license_id").agg(
        F.max("containment").alias("containment"),
        best.alias("first_shingle"),
        F.count_distinct("start").alias("n_windows"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every license found in every row of documents; nulls, ties and empty tables as scan() states."""
    return scan(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LIST = "[x FOR x IN string_split_regex(lower({}), '[^\\pL\\pN]+') IF x <> '']"
OP5_SQL = f"""
WITH t0 AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}) v(license_id, text)),
tw AS (SELECT license_id, {_LIST.format("text")} AS ws FROM t0),
ts AS (SELECT DISTINCT license_id, array_to_string(list_slice(ws, i, i + {WORDS - 1}), ' ') AS g FROM tw, unnest(range(1, len(ws) - {WORDS - 2})) u(i)),
tn AS (SELECT license_id, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS size FROM ts GROUP BY 1),
dw AS (SELECT doc_id, row_number() OVER () AS r, {_LIST.format("coalesce(text, '')")} AS ws FROM documents),
ds AS (SELECT doc_id, r, i - 1 AS i, array_to_string(list_slice(ws, i, i + {WORDS - 1}), ' ') AS g FROM dw, unnest(range(1, len(ws) - {WORDS - 2})) u(i)),
hit AS (SELECT doc_id, r, license_id, size, n, i, g FROM ds JOIN ts USING (g) JOIN tn USING (license_id)),
win AS (SELECT doc_id, r, license_id, j * size AS start, n, count(DISTINCT g) AS shared FROM hit, unnest(list_distinct([i // size, greatest(i // size - 1, 0)])) u(j) GROUP BY ALL),
good AS (SELECT *, CAST(shared AS DOUBLE) / n AS c FROM win WHERE 100 * shared >= {PERCENT} * n)
SELECT doc_id, license_id, max(c) AS containment, CAST(arg_max(start, c * 1000000000 - start) AS INTEGER) AS first_shingle, count(DISTINCT start) AS n_windows FROM good GROUP BY 1, 2
"""
