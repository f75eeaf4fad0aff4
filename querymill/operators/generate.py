"""Clean-up of what a model generated."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.text import strip

# Default stop sequences.
STOP_SEQUENCES = ("\n\n", "<|eot_id|>", "Question:", "Schema:")


def without_echo(generated: Column, prompt_text: Column) -> Column:
    """Generated text without the prompt in front of it."""
    echoed = F.startswith(generated, prompt_text)
    rest = F.substring(generated, F.length(prompt_text) + 1, F.length(generated))
    return strip(F.when(echoed, rest).otherwise(generated))


def until_stop(text: Column, stops: Sequence[str] = STOP_SEQUENCES) -> Column:
    """Cut at the earliest stop sequence."""
    if not stops:
        return text
    return F.get(F.split(text, "|".join(re.escape(s) for s in stops), 2), F.lit(0))
