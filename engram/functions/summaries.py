"""Prompt assembly and the reading of heading/summary responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.text import once, strip

# Texts that stored rows must carry.
DEFAULT_HEADING = "Technical Discussion Summary"
FALLBACK_HEADING = "Developer Chat Summary"
FALLBACK_SUMMARY = "Chat log with %s messages."
FAILED_SUMMARY = " Failed to generate AI summary: "
EMPTY_LOG = "chat_log is required and cannot be empty"

PROMPT_TEMPLATE = (
    "Summarise the conversation below.\n\nContext: {context}\n\nChat Log:\n{chat}\n\n"
    "Answer with a line 'Heading:' followed by a title of at most ten words,\n"
    "then a line 'Summary:' followed by the technical decisions and changes."
)

# A header is a line that starts with one of these, in any case, after optional blanks.
_BLANKS = r"[^\S\n]*"
_HEADING = rf"(?i)^{_BLANKS}(?:1\. )?heading:"
_SUMMARY = rf"(?i)^{_BLANKS}(?:2\. )?summary:"
_SECTION_START = rf"(?im)(?=^{_BLANKS}(?:(?:1\. )?heading:|(?:2\. )?summary:))"


def build_prompt(context: Column, chat: Column, template: str = PROMPT_TEMPLATE) -> Column:
    before, rest = template.split("{context}")
    between, after = rest.split("{chat}")
    return F.concat(
        F.lit(before), F.coalesce(context, F.lit("")), F.lit(between), chat, F.lit(after)
    )


def _later_lines(section: Column) -> Column:
    """Non-empty trimmed lines after the header line of a section."""
    lines = F.split(section, "\n")
    rest = F.slice(lines, 2, F.size(lines))
    return F.filter(F.transform(rest, strip), lambda line: line != "")


def parse_summary(response: Column) -> Column:
    """STRUCT<heading, summary> of a response that names its parts line by line.

    The last heading header decides; its text may follow on a later line. Text on the
    line of a summary header is not part of the summary. Without summary lines the whole
    response is the summary; without a heading the default heading is used.
    """
    sections = F.split(strip(response), _SECTION_START)
    return once(
        F.struct(
            once(
                F.try_element_at(F.filter(sections, lambda s: s.rlike(_HEADING)), F.lit(-1)),
                _heading,
            ).alias("heading"),
            once(
                F.flatten(
                    F.transform(F.filter(sections, lambda s: s.rlike(_SUMMARY)), _later_lines)
                ),
                lambda body: F.when(F.size(body) > 0, F.array_join(body, "\n")).otherwise(response),
            ).alias("summary"),
        ),
        lambda parsed: parsed,
    )


def _heading(section: Column) -> Column:
    inline = strip(F.regexp_extract(section, r"^[^:\n]*:([^\n]*)", 1))
    return F.coalesce(
        F.nullif(inline, F.lit("")),
        F.get(_later_lines(section), F.lit(0)),
        F.lit(DEFAULT_HEADING),
    )


def fallback_summary(n_messages: Column) -> Column:
    """STRUCT<heading, summary> for a chat log nothing could be extracted from."""
    return F.struct(
        F.lit(FALLBACK_HEADING).alias("heading"),
        F.format_string(FALLBACK_SUMMARY, n_messages.cast("string")).alias("summary"),
    )
