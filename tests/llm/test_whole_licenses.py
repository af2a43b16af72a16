"""Licence names in every spelling that their rules describe, and over line ends."""

import numpy as np
import pytest

from chimerascope.llm import licenses


def labels(text):
    return set(licenses.Scanner().scan(np.frombuffer(text.encode(), np.uint8))[5].split(","))


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("cc attribution-sharealike", "cc-by-sa"),
        ("under CC-BY-SA 4.0 only", "cc-by-sa-4.0"),
        ("CC-BY-NC-ND", "cc-by-nc-nd"),
        ("the Apache\nLicense", "apache"),
        ("Apache  License\r\n   Version 2.0, January 2004", "apache-2.0"),
        ("Open\n\tDatabase License", "odbl"),
        ("GNU Lesser\nGeneral Public License v2.1", "lgpl-2.1"),
        ("Apache License  2.0", "apache-2.0"),
    ],
)
def test_spellings(text, label):
    assert label in labels(text)


@pytest.mark.parametrize("gap", ["\n", "\n\n"])
def test_numbered_lines_are_no_versions(gap):
    assert labels(f"Apache License{gap}1. Definitions") == {"apache"}


def test_lesser_over_a_line_end_is_not_gpl():
    assert not {"gpl-2.0", "gpl-2.1"} & labels("GNU Lesser\nGeneral Public\nLicense 2.1")
