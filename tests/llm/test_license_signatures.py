"""Every family's name, notice, short name and tag, its sentences, and texts that name no licence."""

import numpy as np
import pytest

from chimerascope.llm import licenses

SCANNER = licenses.Scanner()
FAMILIES = {f[0]: f for f in licenses._FAMILIES}
BODIES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "# Redistribution and use in source and binary\n#   forms, with or without modification, are permitted provided that",
    "bsd-3-clause": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from it",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "apache-2.0": " * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software",
    "proprietary": "No part of this document may be reproduced in any form",
}


def labels(text):
    return set(SCANNER.scan(np.frombuffer(text.encode(), np.uint8))[5].split(",")) - {""}


@pytest.mark.parametrize("label", FAMILIES)
def test_names(label):
    example = FAMILIES[label][5]
    assert label in labels(f"It comes with the {example}.") and label in labels(f"see\n{example}\n")
    assert label not in labels(" ".join(f"q{word}q" for word in example.split()))


@pytest.mark.parametrize("label", [f for f, row in FAMILIES.items() if row[4]])
def test_versions(label):
    *_, versions, example = FAMILIES[label]
    for version in versions:
        assert f"{label}-{version}" in labels(f"under the {example}, version {version}.") | labels(f"under {example} {version}")
        assert labels(f"SPDX-License-Identifier: {label}-{version}") == {f"{label}-{version}"} or label.startswith("cc")
    assert not any(x.startswith(f"{label}-") and x != label for x in labels(f"{example} 77.5 and more"))


@pytest.mark.parametrize("label", ["mit", "bsd", "apache", "isc", "zlib", "gpl", "lgpl", "mpl"])
def test_short_names(label):
    for text in (f"released under {label}", f"license: {label.upper()}", f"an {label}-licensed tool", f"distributed under the terms of the\n{label}"):
        assert label in labels(text), text
    assert label not in labels(f"the {label[:2]} limits of a {label}x simple example") and not labels("a commit limits the replies")


@pytest.mark.parametrize("label", BODIES)
def test_sentences(label):
    assert label in labels(f"Some words before.\n\n{BODIES[label]}\n\nand after")


def test_every_sentence_passes_its_keyword():
    for label, pattern, gate in licenses._SENTENCES:
        plain = licenses.re.sub(r"\[sc\]|\[cs\]", "s", pattern).replace("\\", "")
        assert gate.split()[0] in plain, (label, gate)


def test_expressions():
    assert labels("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\n") == {"mit", "apache-2.0", "bsd-3-clause"}
    assert labels("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0") == {"gpl-2.0"}
    assert labels("SPDX-License-Identifier: MPL-2.0+") == {"mpl-2.0"} and "mit" not in labels("SPDX-License-Identifier: ISC\nMIT is a place")


@pytest.mark.parametrize("text", [
    "class ServiceImpl 2.0 release", "see impl 2 below", "the epl2.org page", "simple example 3.0", "a fair price for the ruby ring", "python 2.0 and php 3.0 are old", "published by the press", "use with care",
    "He studied ASL", "published by Nokia in 1999", "shared with Ruby yesterday", "this book was published by Boost", "provided by Unicode", "covered under fair use", "released under Python 2.0",
])
def test_no_licence(text):
    assert labels(text) == set()


DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY. IN NO EVENT SHALL THE '
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to deal in it and to permit persons to whom the Software is furnished to do so"
# The base phrase in these notices gives gpl whatever the method finds.
NOTICE = "under the terms of the GNU {} General Public License as published by\nthe Free Software Foundation; either version {} of the License, or later"


@pytest.mark.parametrize(("text", "wanted"), [
    (f"{BODIES['unlicense']}\n\n{DISCLAIMER}AUTHORS BE LIABLE FOR ANY CLAIM", {"unlicense"}),
    (f"{BODIES['boost']}.\n{DISCLAIMER}COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE", {"boost"}),
    (f"{DISCLAIMER}AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", {"mit"}),
    (f"{GRANT}, subject to the following conditions:\n\n{DISCLAIMER}AUTHORS OR COPYRIGHT HOLDERS BE LIABLE", {"mit"}),
    (f"{GRANT}.\n\n{DISCLAIMER}AUTHORS OR COPYRIGHT HOLDERS BE LIABLE", {"mit-0"}),
    (NOTICE.format("Lesser", "2.1"), {"lgpl-2.1", "gpl"}), (NOTICE.format("Library", "2"), {"lgpl-2.0", "gpl"}), (NOTICE.format("Lesser", "3"), {"lgpl-3.0", "gpl"}), (NOTICE.format("Affero", "3"), {"agpl-3.0", "gpl"}),
    ('license = "Apache-2.0"', {"apache-2.0"}), ("License: GPL v3", {"gpl-3.0"}), ("'license': 'MPL 2.0',", {"mpl-2.0"}), ("license: MIT", {"mit"}), ("the ASL 2.0", {"apache-2.0"}),
    ("licensed under Ruby", {"ruby"}), ("released under the Boost license", {"boost"}), ("licensed by MIT terms", {"mit"}),
])
def test_shared_sentences_notices_and_fields(text, wanted):
    assert labels(text) == wanted
