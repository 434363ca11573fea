import duckdb
import pytest

from pagewright.llm import licenses

CASES = [
    ("Released under the MIT License.", "mit-short", "MIT"),
    ("Some words.\nThis work is licensed under the GNU General Public License, version 3.\nMore words", "gpl3-licensed", "GPL-3.0-only"),
    ("Licensed under the GNU General Public License, version 2; or (at your option) any later version.", "gpl2-licensed or-later", "GPL-2.0-or-later"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc4", "CC-BY-NC-4.0"),
    ("Copyright (c) 2020 A. Writer\nAll rights reserved.", "copyright reserved", "Proprietary"),
    ("All rights reserved. Licensed under the Apache License, Version 2.0.", "reserved apache2-licensed", "Apache-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd-redistribute bsd-source", "BSD-2-Clause"),
    ("Copyright law is discussed in this licence essay.", None, None),
    ("Copyright 2019-2021 someone", "copyright", ""),
    ("", None, None),
    (None, None, None),
    ("The licence of poets! " * 3000 + "\nMIT License", "mit-title", "MIT"),
]


MIT = """MIT License

Copyright (c) 2021 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD3 = """Copyright (c) 2020, A. Writer
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
BSD2 = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE") :]
APACHE = """/*
 * Copyright 2019 The Writers
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
code();
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
GPL2 = """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License
# as published by the Free Software Foundation; either version 2
# of the License, or (at your option) any later version.
"""
ISC = "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that the above\r\ncopyright notice and this permission notice appear in all copies.\r\n"
#: Texts as published, wrapped; some inside other prose.
CASES += [
    (MIT, "mit-title copyright mit-grant mit-notice mit-warranty mit-liability", "MIT"),
    (MIT[MIT.index("Copyright") :], "copyright mit-grant mit-notice mit-warranty mit-liability", "MIT"),
    (BSD3, "copyright reserved bsd-redistribute bsd-source bsd-binary bsd-no-endorse bsd-disclaimer", "BSD-3-Clause"),
    (BSD3.replace("the copyright holder nor", "Writers and Friends nor"), "copyright reserved bsd-redistribute bsd-source bsd-binary bsd-no-endorse bsd-disclaimer", "BSD-3-Clause"),
    (BSD2, "copyright reserved bsd-redistribute bsd-source bsd-binary bsd-disclaimer", "BSD-2-Clause"),
    (APACHE, "copyright apache2-licensed apache2-compliance apache2-copy apache2-basis apache2-see", "Apache-2.0"),
    (MPL, "mpl2-terms mpl2-copy", "MPL-2.0"),
    (GPL3, "gpl3-or-later gpl-see", "GPL-3.0-or-later"),
    (GPL2, "gpl-terms version2-later", "GPL-2.0-or-later"),
    ("Words before.\n\n" + MIT.replace("MIT License\n", "") + "\nWords after.", "copyright mit-grant mit-notice mit-warranty mit-liability", "MIT"),
    (ISC, "isc-grant", "ISC"),
    ("// SPDX-License-Identifier: Apache-2.0\nint x;", "apache2-licensed", "Apache-2.0"),
    ("Permission is hereby granted, free of charge.", "permission-free", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", "y", 1.5) for k, (t, _, _) in enumerate(CASES)] + [(0, CASES[0][0], "x", "y", 1.5), (None, CASES[0][0], "x", "y", 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, rules string, ids string, licenses double")


def test_cases(docs):
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append((r.sentence_ids, r.licenses))
    for k, (_, ids, spdx) in enumerate(CASES):
        assert set(got.get(k, [])) == (set() if ids is None else {(ids, spdx)})
    assert len(got[0]) == 2 and len(got[None]) == 1


def test_sql_gives_the_same(docs):
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    want = c.sql(licenses.oracle_sql())
    rows = sorted(map(str, want.fetchall()))
    assert rows == sorted(str(tuple(r)) for r in licenses.scan(docs).select(*want.columns).collect())


def test_empty(spark, empty_docs):
    assert licenses.scan(empty_docs).count() == 0


def test_table_is_consistent():
    rules = licenses.RULES + licenses.WEAK_RULES
    used = {i for _, _, seq in rules for i in seq}
    assert used <= set(licenses.SENTENCES) | {licenses.COPYRIGHT}
    assert len({n for n, _, _ in rules}) == len(rules)
    assert all(s == licenses.normal(s) for s in licenses.KNOWN)
