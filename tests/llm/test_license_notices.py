"""Notices as they stand in real files, written by hand and not from the module's tables."""

import pytest

from wareflow.llm.licenses import RULES, SENTENCES, SentenceRules

LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""
GOOGLE = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//
//    * Redistributions of source code must retain the above copyright
// notice, this list of conditions and the following disclaimer.
//    * Redistributions in binary form must reproduce the above
// copyright notice, this list of conditions and the following disclaimer
// in the documentation and/or other materials provided with the
// distribution.
//    * Neither the name of Google Inc. nor the names of its
// contributors may be used to endorse or promote products derived from
// this software without specific prior written permission."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


@pytest.fixture(scope="module")
def known():
    return SentenceRules(SENTENCES, RULES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("This project is released under the MIT License.", ["MIT"]),
        ("This file is licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Fast Parser is distributed under the terms of the MIT licence, see the LICENSE.md file for details.", ["MIT"]),
        ("Unless otherwise noted, content on this site is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
        ("Dual licensed under the MIT license or the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("Licensed under the MIT License\nand the Apache License 2.0.", ["MIT", "Apache-2.0"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3 or later.", ["AGPL-3.0-or-later"]),
        ("Released under CC0 1.0 Universal.", ["CC0-1.0"]),
        ("This program is made available under the terms of the Eclipse Public License v2.0.", ["EPL-2.0"]),
        ("## License\n\nBSD-3-Clause\n", ["BSD-3-Clause"]),
        ("The MIT License (MIT)\n\nCopyright (c) 2014 Someone", ["MIT"]),
        ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", ["GPL-3.0"]),
        ("This library is licensed under the LGPLv2.1+.", ["LGPL-2.1-or-later"]),
        ("This library is licensed under the GPLv2.", ["GPL-2.0"]),
        (LGPL, ["LGPL-2.1-or-later"]),
        (LGPL.replace("software;", "software,"), ["LGPL-2.1-or-later"]),
        ("Foo is free software;\n" + LGPL.split("; ", 1)[1], ["LGPL-2.1-or-later"]),
        ("Licensed under " + "the MIT License and " * 3000 + "ISC.", ["MIT"] * 3000 + ["ISC"]),
        (GOOGLE, ["BSD-3-Clause"]),
        (GOOGLE.replace("//    * R", "//  1) R").replace("//    * N", "//  3) N"), ["BSD-3-Clause"]),
        (ZLIB, ["Zlib"]),
        ("To the extent possible under law, Jane Q. Doe has waived all copyright and related or neighboring rights to this work.", ["CC0-1.0"]),
        ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR mit */", ["GPL-2.0-only", "MIT"]),
        ("# SPDX-License-Identifier: OFL-1.1\nx", ["OFL-1.1"]),
        ("<!-- SPDX-License-Identifier: EPL-2.0 -->", ["EPL-2.0"]),
        ("SPDX-License-Identifier: see the file beside", []),
        ("SPDX-License-Identifier: NOASSERTION", []),
        ("No part of this is licensed under the MIT License.", []),
        ("This project is not released under the MIT License.", []),
        ("This project is released under the MIT License of old, or so they say.", []),
        ("We met under the old bridge. The license plate was gone.", []),
    ],
)
def test_hand_written(known, text, want):
    found = known.licences(text.encode(), 3)
    assert [m[0] for m in found] == want
    for _, begin, end in found:
        assert 0 <= begin < end <= len(text.encode())
