"""Licence scans in DataFrame functions only.

A text's lines, sentences, paragraphs, runs of paragraphs and the text as a whole are normalised
(lower case, runs of letters and digits) and compared with licence templates, short notices and full
texts, by the Dice coefficient over distinct word bigrams. Two bounds prune before
any comparison, and neither can lose a match: a segment whose number of bigrams lies outside what
the threshold allows for a template, and a segment that has none of the words without which a
template cannot reach the threshold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8

#: Notices as licences word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-SPDX": "SPDX-License-Identifier: MIT",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "GPL-short": "Licensed under the GNU General Public License v3.0.",
    "GPL-work": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-short": "Licensed under CC BY-NC 4.0.",
    "MIT-paragraph": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

#: The licence a template speaks for, where its name says another thing. The first sentence of both BSD texts names their family.
LICENSE_OF = {
    "Apache-2.0-notice": "Apache-2.0",
    "Apache-2.0-header": "Apache-2.0",
    "MIT-SPDX": "MIT",
    "MIT-grant": "MIT",
    "MIT-paragraph": "MIT",
    "MIT-text": "MIT",
    "BSD-3-Clause": "BSD",
    "BSD-2-Clause-text": "BSD-2-Clause",
    "BSD-3-Clause-text": "BSD-3-Clause",
    "GPL-short": "GPL-3.0",
    "GPL-work": "GPL-3.0",
    "GPL-3.0-header": "GPL-3.0",
    "MPL-2.0-header": "MPL-2.0",
    "ISC-text": "ISC",
    "Unlicense-text": "Unlicense",
    "CC-BY-short": "CC-BY-4.0",
    "CC-BY-NC-short": "CC-BY-NC-4.0",
    "Zlib-text": "Zlib",
}

#: Paragraphs in a row that are compared as one segment, at most; the whole text is one too.
RUN = 6


def bigrams_of(text: str) -> list[str]:
    words = re.findall(r"[\w]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed_words(bigrams: list[str], threshold: float) -> set[str]:
    """Words of which a segment must have one: without them too few of the template's bigrams can be shared."""
    left, words = list(bigrams), set()
    while 2 * len(left) >= threshold * (len(left) + len(bigrams)) and left:
        count = {w: sum(w in b.split() for b in left) for b in left for w in b.split()}
        best = max(count, key=lambda w: (len(w) > 4, len(w) * count[w], w))
        words.add(best)
        left = [b for b in left if best not in b.split()]
    return words


def normalised_words(segment: Column) -> Column:
    return F.filter(F.split(F.lower(segment), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def bigrams(segment: Column) -> Column:
    words = normalised_words(segment)
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def paragraph_runs(text: Column) -> Column:
    """The paragraphs of a text, and their runs of up to RUN."""
    parts = F.split(text, r"\n\s*\n")
    runs = lambda n: F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, n), "\n"))
    return F.flatten(F.array(*[runs(F.lit(n)) for n in range(1, RUN + 1)]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row and column of ``docs`` plus ``licenses``: matches (license, template, dice, segment) by template.

    A segment speaks for the templates of its highest Dice only (6 decimals), so the longer of two like texts is not taken for
    both. Of several segments for one template the one of highest Dice counts, then the least by text. A family's match
    (BSD) goes where one of its licences (BSD-2-Clause) is found in the same text.
    Null or empty texts, and texts of one word, match nothing. Null doc_id and repeated rows are
    judged like others; ties between templates are all listed. Empty table: no rows. A column named
    licenses is replaced, no other is touched. There is no shuffle.
    """
    grams = {k: bigrams_of(v) for k, v in templates.items()}
    wanted = sorted({w for g in grams.values() for w in needed_words(g, threshold)})
    probe = rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(map(re.escape, wanted))})(?![\p{{L}}\p{{N}}_])"
    low = min(len(g) for g in grams.values()) * threshold / (2 - threshold)
    high = max(len(g) for g in grams.values()) * (2 - threshold) / threshold
    text = common.text_column(docs)
    segments = F.array_distinct(F.concat(F.array(text), F.split(text, r"\n"), F.split(text, r"[.!?]\s+"), paragraph_runs(text)))
    likely = F.when(text.rlike(probe), F.filter(segments, lambda s: s.rlike(probe))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = docs.drop("licenses").withColumn("licenses", likely)
    rows = rows.withColumn("licenses", F.transform("licenses", lambda s: F.struct(s.alias("segment"), bigrams(s).alias("grams"))))
    rows = rows.withColumn("licenses", F.filter("licenses", lambda x: F.size(x["grams"]).between(low, high)))

    def dice(x: Column, own: list[str]) -> Column:
        size = F.size(x["grams"])
        fits = (size >= len(own) * threshold / (2 - threshold)) & (size <= len(own) * (2 - threshold) / threshold)
        share = 2 * F.size(F.array_intersect(x["grams"], F.array(*[F.lit(g) for g in own]))) / (size + len(own))
        return F.when(fits, F.round(share, 6)).otherwise(0.0)

    names = sorted(grams)
    rows = rows.withColumn("licenses", F.transform("licenses", lambda x: F.struct(x["segment"].alias("segment"), F.array(*[dice(x, grams[k]) for k in names]).alias("dice"))))
    rows = rows.withColumn("licenses", F.transform("licenses", lambda x: F.struct(x["segment"].alias("segment"), x["dice"].alias("dice"), F.array_max(x["dice"]).alias("top"))))
    rows = rows.withColumn("licenses", F.filter("licenses", lambda x: x["top"] >= threshold))

    def best(place: int, name: str) -> Column:
        own = F.filter("licenses", lambda x: x["dice"][place] == x["top"])
        first = F.array_min(F.transform(own, lambda x: F.struct((-x["top"]).alias("minus"), x["segment"].alias("segment"))))
        return F.when(first.isNotNull(), F.struct(F.lit(LICENSE_OF.get(name, name)).alias("license"), F.lit(name).alias("template"), (-first["minus"]).alias("dice"), first["segment"].alias("segment")))

    found = F.filter(F.array(*[best(i, k) for i, k in enumerate(names)]), lambda m: m.isNotNull())
    none = F.expr("cast(array() as array<struct<license:string,template:string,dice:double,segment:string>>)")
    rows = rows.withColumn("licenses", F.when(F.size("licenses") > 0, found).otherwise(none))
    of_family = lambda m: F.exists("licenses", lambda n: F.startswith(n["license"], F.concat(m["license"], F.lit("-"))))
    return rows.withColumn("licenses", F.filter("licenses", lambda m: ~of_family(m)))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its licences, each once, the templates that speak for them, and the highest Dice."""
    got = scan(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))
    templates = F.transform("licenses", lambda m: m["template"])
    best = F.coalesce(F.array_max(F.transform("licenses", lambda m: m["dice"])), F.lit(0.0))
    return got.select("doc_id", F.size(ids).cast("long").alias("n_licenses"), F.array_join(ids, ",").alias("licenses"), F.array_join(templates, ",").alias("templates"), best.alias("best_dice"))
