import re

from strandline.llm import licenses

MIT = """MIT Licence

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_tables_agree():
    assert all(re.search(licenses.ANCHOR, text) for text in licenses.SENTENCES.values())
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    assert all(i in licenses.SENTENCES for _, ids in licenses.RULES for i in ids)


def test_texts(spark):
    texts = [
        ("text before\n" + MIT, "MIT"),
        ("Nothing.\n# Licensed under the Apache License, Version 2.0.\nMore", "Apache-2.0"),
        ("Released under the MIT License. Licensed under CC BY-NC 4.0.", "MIT,CC-BY-NC-4.0"),
        ("This file is licensed under the GNU General\npublic license, version 3.", "GPL-3.0-only"),
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("licensed to kill", ""),
        ("Licensed under the Apache License, Version 2.0 or another", ""),
    ]
    rows = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(texts)] + [(90, None, ""), (91, "", ""), (92, "no such word", "")], "doc_id long, text string, sequence string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert {k: got[k].licenses for k in range(5)} == {k: w for k, (_, w) in enumerate(texts) if k < 5}
    assert got[5].unknown == 1 and got[6].licenses == "" and not {90, 91, 92} & set(got)


def test_plan_has_no_python_and_no_shuffle(spark, odd_docs, no_docs):
    plan = licenses.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0


def test_every_row_of_repeated_documents(spark):
    rows = spark.createDataFrame([(1, "Released under the MIT License.")] * 3, "doc_id long, text string")
    assert [r.licenses for r in licenses.scan(rows).collect()] == ["MIT"] * 3


BSD = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
NARROW_MIT = MIT.replace("EXPRESS OR IMPLIED", "EXPRESS OR\nIMPLIED").replace("THE USE OR OTHER", "THE\nUSE OR OTHER")


def test_published_texts(spark):
    kinds = {"plain": "", "indented": "    ", "block": " * ", "slashes": "// "}
    whole = {"BSD-2-Clause": BSD % "", "BSD-3-Clause": BSD % ENDORSE, "GPL-2.0-or-later": GPL2, "MIT": NARROW_MIT, "Apache-2.0": APACHE}
    cases = [(name, kind, "".join(mark + line for line in text.splitlines(True))) for name, text in whole.items() for kind, mark in kinds.items()]
    rows = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert [(n, k, got[i].licenses) for i, (n, k, _) in enumerate(cases)] == [(n, k, n) for n, k, _ in cases]
    rules = {name: "".join(f"<{i}>" for i in ids) for name, ids in reversed(licenses.RULES) if len(ids) > 2}
    assert all(rules[n] in got[i].sequence for i, (n, _, _) in enumerate(cases))


def test_neighbours_of_a_known_sentence(spark):
    texts = [
        ("Licensed under the MIT License\n    import this", "MIT", 0),
        ("some words\n    licensed under the MIT License\n    x = 1", "MIT", 0),
        ("No warranty is\n    given by\n    us", "", 1),
        ("Licensed under the MIT\n  License or another", "", 1),
    ]
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    got = sorted(licenses.scan(rows).collect(), key=lambda r: r.doc_id)
    assert [(r.licenses, r.unknown) for r in got] == [(w, n) for _, w, n in texts]


def test_every_lead_in_with_every_name(spark):
    names = {
        "the MIT License": "MIT", "MIT": "MIT", "the Apache License, Version 2.0": "Apache-2.0", "Apache 2.0": "Apache-2.0", "the BSD license": "BSD",
        "the 2-Clause BSD License": "BSD-2-Clause", "the BSD-3-Clause License": "BSD-3-Clause", "the ISC License": "ISC",
        "the Mozilla Public License, v. 2.0": "MPL-2.0", "MPL 2.0": "MPL-2.0", "the GNU GPL, version 2": "GPL-2.0-only",
        "the GNU General Public License, version 3": "GPL-3.0-only", "the GPLv2": "GPL-2.0-only", "GPL v3+": "GPL-3.0-or-later",
        "the GNU GPL version 2 or (at your option) any later version": "GPL-2.0-or-later", "GNU LGPL 3.0 or later": "LGPL-3.0-or-later",
        "the GNU Lesser\n  General Public License version 3": "LGPL-3.0-only", "CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0",
        "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
        "a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
        "a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
    }
    leads = ["Licensed under", "Released under", "This work is licensed under", "This project is released under", "# The software is licensed under"]
    tags = [n for n, *_ in licenses.NAMES if n != "BSD"]
    cases = [(f"Text.\n{lead} {name}.\nMore", w) for lead in leads for name, w in names.items()]
    cases += [(f"// SPDX-License-Identifier: {t}\ncode", t) for t in tags]
    cases += [("SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"), ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later")]
    cases += [("Licensed under MIT or Apache 2.0", ""), ("Licensed under the GPL 2 with an exception", ""), ("Licensed under CC BY 3.0", "")]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(rows).collect()}
    assert [(t, got[k]) for k, (t, _) in enumerate(cases)] == cases
    assert {n for n, _ in licenses.RULES} <= {n for n, *_ in licenses.NAMES}
