"""Plain-Python versions that tests compare with."""

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})
