"""Clients that the command line's tests name."""

import json
import re
from pathlib import Path


def echo():
    """Answers with the label in the text; texts with 'broken' fail, until the file 'mended' is there."""

    def call(model, system, text):
        assert system == "Which colour?"
        found = re.findall(r"(red|blue|broken)", text)
        if "broken" in found and not Path(model).exists():
            raise ValueError("no answer")
        found = ["blue" if x == "broken" else x for x in found]
        if text.startswith("1. "):
            return json.dumps([{"colour": x} for x in found])
        return json.dumps({"colour": found[0]})

    return call
