import re

import pytest

from quire.functions import markers as m


def test_patterns_take_odd_spaces_and_tell_values_apart():
    assert re.fullmatch(m.PAGE_BEGIN.pattern, "<!--PDF_PAGE_BEGIN  3-->")[1] == "3"
    assert not re.search(m.PAGE_BEGIN.bare, "<!-- PDF_PAGE_BEGIN 3 -->")
    assert re.fullmatch(m.PAGE_BEGIN.around, "<!-- PDF_PAGE_BEGIN 3 -->").groups() == ("<!-- PDF_PAGE_BEGIN ", "3", " -->")
    assert re.search(m.IMAGE_RECT.pattern, "<!-- IMAGE_RECT 0.1,0.2,0.3,1.2.3 -->").groups() == ("0.1", "0.2", "0.3", "1.2.3")
    assert re.search(m.PAGE_SKIP.alone, "a\n <!-- PDF_PAGE_SKIP --> \nb") and not re.search(m.PAGE_SKIP.alone, "a <!-- PDF_PAGE_SKIP -->")


def test_writing():
    assert m.PAGE_END.write(7) == "<!-- PDF_PAGE_END 7 -->" and m.PAGE_SKIP.write() == "<!-- PDF_PAGE_SKIP -->"
    assert m.IMAGE_RECT.example == "<!-- IMAGE_RECT 0.02,0.15,0.98,0.65 -->"
    for marker, values in ((m.PAGE_SKIP, (1,)), (m.PAGE_BEGIN, ()), (m.IMAGE_RECT, (1, 2))):
        with pytest.raises(TypeError):
            marker.write(*values)
