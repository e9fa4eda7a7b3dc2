"""Helpers that the tests of this folder share."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")
