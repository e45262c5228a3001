"""The code of one entry beside unlisted remarks or more typing errors: threshold and margin decide."""

import pytest

from tests.llm.test_canonical import meant

BY_CODE = [
    ("Tavrion Axis 3 3656G OEM", 1), ("Ostrek Rho 6 8833HS OEM", 5), ("Tavrrion Axxis 3 3656G", 1),
    ("Tavrion Axis 3 3657G OEM", 0), ("Tavrion Axis 3 3656G 3607U", 0), ("Zephyrix Zed 3656G tray box kit", 0), ("Irid 43 Pro", 0),
]


@pytest.mark.parametrize("value,entry", BY_CODE)
def test_resolve_by_code(value, entry):
    assert meant(value)[0] == entry
