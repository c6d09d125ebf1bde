"""Near-miss notices: a licence is not taken for its kin."""

import pytest

from railweave.llm import licenses

GIVEN = tuple(sorted(licenses.TEMPLATES.items()))
GPL = licenses.TEMPLATES["GPL-3.0"]


def names(text):
    return {f[0] for f in licenses.find(f"some words before it. {text} And others after it.", GIVEN)}


@pytest.mark.parametrize("text, want", [
    ("Released under the BSD License.", {"BSD-notice"}),
    ("Released under the Foo License.", set()),
    ("Licensed under CC BY 4.0.", {"CC-BY-4.0-short-notice"}),
    ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0-short-notice"}),
    ("Licensed under CC BY-NC-SA 4.0.", set()),
    ("Licensed under CC BY-NC 3.0.", set()),
    ("Licensed under the Apache License, Version 1.1.", set()),
    ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0-notice"}),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0-notice"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", set()),
    (GPL.replace("version 3", "version 2"), {"GPL-2.0"}),
    (GPL.replace("General Public", "Lesser General Public"), {"LGPL-3.0"}),
    (GPL.replace("General Public", "Affero General Public"), {"AGPL-3.0"}),
    ("Licensed under CC BY-SA 4.0. Licensed under CC BY-NC 4.0.", {"CC-BY-SA-4.0-short-notice", "CC-BY-NC-4.0-notice"}),
])
def test_kin_are_told_apart(text, want):
    assert names(text) == want


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_exact_templates_are_found(name):
    found = names(licenses.TEMPLATES[name])
    assert name in found and found <= {name, f"{name}-notice"}
