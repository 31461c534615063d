"""Whole licence texts and notices, hard-wrapped."""

import pytest

from tidelog.llm import licences

MIT = """The MIT License (MIT)

Copyright (c) 2020 Jo Doe

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
BSD = """Copyright (c) 2020, Jo Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NO_ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED.
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
GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{then} either version {n} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
TEXTS = {
    MIT: (["MIT"], "Copyright,MITGrant,MITNotice,MITAsIs,NoEvent"),
    BSD + BSD_END: (["BSD-2-Clause"], "Copyright,BSDGrant,BSDSource,BSDBinary,BSDAsIs,NoEvent"),
    BSD + NO_ENDORSE + BSD_END: (["BSD-3-Clause"], "Copyright,BSDGrant,BSDSource,BSDBinary,BSDNoEndorse,BSDAsIs,NoEvent"),
    APACHE: (["Apache-2.0"], "ApacheUnder,ApacheCompliance,ApacheObtain,ApacheUrl,ApacheAsIs,ApacheSee"),
    GPL.format(mark=":", then=",", kind="", n=3): (["GPL-3.0-or-later"], "GPL3Later,GNUDetails,GNUCopy,GNUSee"),
    GPL.format(mark=";", then=";", kind="", n=2): (["GPL-2.0-or-later"], "GPLTerms,Version2Later,GNUDetails,GNUCopy,GNUSee"),
    GPL.format(mark=":", then=",", kind="Lesser ", n=3): (["LGPL"], "LGPLTerms,GNUDetails,GNUCopy,GNUSee"),
    GPL.format(mark=":", then=",", kind="Affero ", n=3): (["AGPL"], "AGPLTerms,GNUDetails,GNUCopy,GNUSee"),
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_licences(spark, mark):
    texts = {"".join(f"{mark}{line}".rstrip() + "\n" for line in t.splitlines()): v for t, v in TEXTS.items()}
    rows = licences.scanned(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    got = {r["row"]["text"]: (r["licences"], [i for i in r["sentences"] if i != "Unknown"]) for r in rows}
    assert got == {t: (found, ids.split(",")) for t, (found, ids) in texts.items()}


def test_lines_that_are_known_by_themselves_stay_apart(spark):
    cases = {"Copyright (c) 2020 Jo\nAll rights reserved": ["Copyright", "AllRights"], "a heading\nLicensed under the Apache\nLicense, Version 2.0.": ["ApacheUnder"], "no end of this line\nReleased under the MIT License.": ["MITUnder"]}
    rows = licences.scanned(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert {r["row"]["text"]: r["sentences"] for r in rows} == cases


ISC = """Copyright (c) 2020 Jo Doe <jo@x.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.
"""
CC0 = """To the extent possible under law, Jo Doe has waived all copyright and
related or neighboring rights to this work.
"""
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
MORE = {
    ISC: ["ISC"],
    MPL: ["MPL-2.0"],
    EPL: ["EPL-2.0"],
    UNLICENSE: ["Unlicense"],
    CC0: ["CC0-1.0"],
    **{
        f"This work is licensed under a Creative Commons {long} 4.0\nInternational License. To view a copy of this license, visit\nhttp://creativecommons.org/licenses/x/4.0/.\n": [f"CC-{kind}"]
        for kind, long in {
            "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
    },
    "All texts here are licensed under CC BY-NC-SA 4.0.\n": ["CC-BY-NC-SA"],
    "This work is licensed under CC BY-ND 4.0.\n": ["CC-BY-ND"],
    "This work is licensed under CC0 1.0.\n": ["CC0-1.0"],
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_further_licences_wrapped(spark, mark):
    texts = {"".join(f"{mark}{line}".rstrip() + "\n" for line in t.splitlines()): v for t, v in MORE.items()}
    rows = licences.scanned(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r["row"]["text"]: (r["licences"], "Unknown" in r["sentences"]) for r in rows} == {t: (v, False) for t, v in texts.items()}


def test_licences_on_one_line(spark):
    texts = {" ".join(t.split()): v[0] if isinstance(v, tuple) else v for t, v in {**TEXTS, **MORE}.items()}
    rows = licences.scanned(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r["row"]["text"]: r["licences"] for r in rows} == texts


def test_long_tails_are_no_limit(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software " + "and more words " * 2000 + "."
    rows = licences.scanned(spark.createDataFrame([(grant,)], "text string")).collect()
    assert [r["sentences"] for r in rows] == [["MITGrant"]]
