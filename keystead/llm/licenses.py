"""Licence scan by canonical digest lookup, with DataFrame functions only.

Texts are brought to a canonical form (case, punctuation, copyright lines, titles and equivalent spellings)
and their digests are joined to those of known licences. The units that are looked up, each as an entire
text, are the whole document and every one of its lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialise

#: Lengths of known texts that are compared as a list.
MOST_LENGTHS = 2000

# Whole licences, without title and copyright lines.
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>',
}
# Lines that name a licence as its title. They are left out where whole texts are compared.
TITLES = (
    "MIT License", "The MIT License", "The MIT License (MIT)", "MIT No Attribution", "ISC License", "The ISC License", "ISC License (ISC)", "BSD Zero Clause License", "Zero-Clause BSD", "BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License",
    "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "zlib License", "The zlib License", "The zlib/libpng License", "Boost Software License", "Boost Software License - Version 1.0 - August 17th, 2003", "The Unlicense", "License",
)
# Names of licences as notices give them.
NAMES = {
    "MIT": ("MIT License", "MIT license (MIT)", "MIT"), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",), "Zlib": ("zlib License", "zlib/libpng License"), "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "Unlicense": ("Unlicense",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"), "BSD": ("BSD License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0"), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal"),
}
# What notices say around a name.
PHRASES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "This project is licensed under the {}", "This project is licensed under the terms of the {}", "This software is licensed under the {}", "This work is licensed under the {}", "This code is released under the {}")
# Notices that are more than a name.
NOTICES = {
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',),
    "MPL-2.0": ('This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
}
# The GNU licences, their versions, and their notices for one version and for later ones too.
GNU = {"GPL": ("GNU General Public License", ("2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",))}
ONLY = ("This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, version {}.", "This program is free software; you can redistribute it and/or modify it under the terms of the {} version {} as published by the Free Software Foundation.")
LATER = ("This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
# The Creative Commons licences and their versions.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERSIONS = {"4.0": "International", "3.0": "Unported"}
# Length and SHA-256 of the canonical form of longer licences.
DIGESTS = {
    "Apache-2.0": (9926, "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    "Artistic-1.0-Perl": (5833, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    "CC0-1.0": (6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    "GFDL-1.2": (19578, "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    "GFDL-1.3": (22012, "48e9fd49c4c0a8b77831a3d2eea8550f3b67527b1f2631189c657a0977192086"),
    "GPL-1.0": (11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    "GPL-2.0": (17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    "GPL-3.0": (33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    "LGPL-2.0": (24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    "LGPL-2.1": (25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    "LGPL-3.0": (7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    "MPL-1.1": (22431, "af9120248ffd9feada62cb62d18d7104970bad23f2d265fd77eb0cd3c265583b"),
    "MPL-2.0": (14342, "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
}
# Spellings that count as equal, the second form standing for both.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("share alike", "sharealike"),
    ("favour", "favor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("per cent", "percent"), ("https", "http"),
)
#: A line about copyright alone: marks of comments or lists, then the word, the sign or the usual phrase.
COPYRIGHT_LINE = r"^[^a-z0-9©]*(?:copyright(?: *\(c\)| *©| +[0-9]{4}| +by )|©|\(c\) *(?:copyright|[0-9]{4})|all rights reserved)"


def canonical(line: Column) -> Column:
    """The canonical form of a line: '' for a line about copyright; else lower case, other characters
    than letters and digits as single blanks, equivalent spellings as one."""
    low = F.lower(line)
    plain = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    for a, b in SPELLINGS:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(low.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(plain)


def _titles() -> list[str]:
    """Canonical forms of the titles."""
    out = set()
    for t in TITLES:
        plain = re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()
        for a, b in SPELLINGS:
            plain = plain.replace(a, b)
        out.add(plain)
    return sorted(out)


def whole(lines: Column) -> Column:
    """The canonical form of a text from those of its lines: without lines that are empty or a title."""
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.isin(*_titles())), " ")


def canonical_text(text: Column) -> Column:
    """The canonical form of a whole text."""
    return whole(F.transform(F.split(text, "\n", -1), canonical))


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of every text and notice that is known by its wording."""
    out = [*TEXTS.items(), *((k, t) for k, texts in NOTICES.items() for t in texts)]
    names = {k: list(v) for k, v in NAMES.items()}
    for short, (name, versions) in GNU.items():
        for v in versions:
            full = v if "." in v else f"{v}.0"
            only, later = f"{short}-{full}-only", f"{short}-{full}-or-later"
            names[only] = [f"{name}, version {x}" for x in {v, full}] + [f"{name} v{x}" for x in {v, full}]
            names[later] = [f"{x} or later" for x in names[only]] + [f"{x}, or any later version" for x in names[only]]
            out += [(only, t.format(name, v)) for t in ONLY] + [(later, t.format(name, v)) for t in LATER]
    for short, name in COMMONS.items():
        for v, kind in VERSIONS.items():
            names[f"CC-{short}-{v}"] = [f"CC {short} {v}", f"Creative Commons {name} {v} {kind} License", f"Creative Commons {name} {v} License"]
            out.append((f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {name} {v} {kind} License."))
    for license, own in names.items():
        if license != "BSD":
            out.append((license, f"SPDX-License-Identifier: {license}"))
        out += [(license, p.format(n)) for n in own for p in PHRASES]
    return sorted(set(out) | {(k, f"SPDX-License-Identifier: {k}") for k in (*TEXTS, *DIGESTS)})


def known_licenses(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """license, length (of the canonical form) and digest of every known text, written. known has license
    and text; without it they are those of this module."""
    rows = spark.createDataFrame(known_texts(), "license string, text string") if known is None else known.select("license", "text")
    out = rows.withColumn("c", canonical_text(F.col("text"))).select("license", F.char_length("c").alias("length"), F.sha2("c", 256).alias("digest")).where("length > 0")
    if known is None:
        out = out.unionByName(spark.createDataFrame([(k, n, d) for k, (n, d) in DIGESTS.items()], "license string, length int, digest string"))
    return materialise(out.distinct(), "known")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, unit, line, license, digest: a row for each unit of a document that is a known licence.

    unit is `text` (the whole document without titles; line is null) or `line` (line counts from 0). A
    document of one line can be found as both. Null and empty texts match nothing; null and repeated ids
    are scanned as others are; texts of any length are scanned whole; other columns are ignored. Units
    whose canonical length no known text has are left out before digests are made, which loses no match.
    The known licences are joined by digest; they are broadcast only if their written size is below the
    session's limit for it."""
    table = known_licenses(docs.sparkSession, known)
    # one number for each length up to the longest known text; beyond MOST_LENGTHS every unit is digested
    lengths = [x["length"] for x in table.select("length").distinct().limit(MOST_LENGTHS + 1).collect()]

    def units(lines: Column) -> Column:
        one = F.struct(F.lit("text").alias("unit"), F.lit(None).cast("long").alias("line"), whole(lines).alias("c"))
        each = F.transform(lines, lambda x, i: F.struct(F.lit("line").alias("unit"), i.cast("long").alias("line"), x.alias("c")))
        return F.filter(F.concat(F.array(one), each), lambda x: F.char_length(x["c"]).isin(lengths) if len(lengths) <= MOST_LENGTHS else x["c"] != "")

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), canonical)
    rows = docs.select("doc_id", F.explode(let(lines, units)).alias("u")).select("doc_id", "u.unit", "u.line", F.sha2("u.c", 256).alias("digest"))
    return rows.join(table.select("license", "digest"), "digest").select("doc_id", "unit", "line", "license", "digest")
