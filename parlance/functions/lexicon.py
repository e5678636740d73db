"""Patterns, word lists, budgets and thresholds that all operators share.

The values are fixed: results depend on them. Patterns are written for Java's engine: ``(?U)`` makes
its classes Unicode-aware, ``(?d)`` leaves the line feed as the only line end.
"""

from __future__ import annotations

# --- fixed values: patterns -----------------------------------------------------------------
SPEAKER = r"(?mdU)^\s*([A-Z][A-Za-z .'-]{0,39}?):"
NUMBER = r"(?U)(?<!\w)(?:[$£€])?\s*\d+(?:[.,:]\d+)*(?:\s*(?:am|pm|AM|PM|%|dollars?|euros?|pounds?|hours?|minutes?|days?|weeks?))?(?!\w)"
CAPITALISED = r"(?U)\b[A-Z][A-Za-z'-]{1,30}\b"
WORD = r"[A-Za-z][A-Za-z'-]*"
SPACE = r"[\s\x1c-\x1f]"
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SENTENCE_BREAK = rf"(?U)(?<=[.!?]){SPACE}+"
SENTENCE_UNIT = r"[^.!?]++[.!?]"
COMPLETE_SENTENCE = r"""(?dU).+?[.!?](?:["')\]]?)(?:\s+|$)"""
ENDED = r"""(?U)[.!?]["')\]]?\s*$"""
OWNER_LINE = r"(?dU)^\s*([^:]{1,40}):\s*(.+)$"
MODALS = r"(?:will|must|should|can|could|plans? to|needs? to|is going to)"
DIRECTIVES = r"(?:,|\s+(?:will|must|should|needs? to|please))"

# --- fixed values: word lists ---------------------------------------------------------------
#: Capitalised words that are no names, in summaries (case-sensitive).
IGNORED = (
    "The", "A", "An", "This", "That", "These", "Those", "It", "They", "He", "She", "We", "I", "Tomorrow", "Today", "Yesterday",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)
#: The same, in dialogues.
IGNORED_IN_FACTS = ("The", "This", "That", "These", "Those", "A", "An", "I", "He", "She", "We", "They")
#: Words that say nothing about an action.
ACTION_STOP = ("the", "and", "with", "will", "would", "could", "should", "this", "that", "from", "into", "about", "every", "also", "needs", "need")

# --- fixed values: budgets and thresholds ---------------------------------------------------
PROMPT_TOKENS, CHUNK_TOKENS, OVERLAP_TOKENS, GROUP_TOKENS = 412, 280, 20, 320
CHUNK_OUT, MERGE_OUT, FINAL_OUT = 60, 80, 100
DUPLICATE, CONFLICT = 0.82, 0.68
BEST_SUPPORT, SAME_SPEAKER, WEAK, STRONG = 0.50, 0.50, 0.30, 0.60
LONG_TOKENS = 400
TRUNCATION_MARK = "\n[... dialogue truncated ...]\n"

# --- fixed values: instructions -------------------------------------------------------------
DIRECT_INSTRUCTION = "Summarize the following dialogue in one concise paragraph."
CHUNK_INSTRUCTION = "Summarize this dialogue section in at most 60 tokens. Preserve who did what, speaker attribution, decisions, amounts, dates and times. Do not invent facts."
MERGE_INSTRUCTION = (
    "Merge the section summaries into one concise dialogue summary in at most 100 tokens. Preserve speaker attribution and important numbers or times. "
    "Use only supported facts. Never transfer an action from one person to another, remove repeated events, and finish every sentence."
)
COMPLETE_INSTRUCTION = "Rewrite the draft as a concise summary using complete sentences only. Preserve its supported facts, remove repetitions, and do not add or reassign actions."

# --- fixed values: records, sheets, reasons -------------------------------------------------
#: Reasons of repair records.
WRONG_ACTOR, REPEATED_EVENT, OPPOSED_EVENT = "unsupported_explicit_attribution", "near_duplicate_event", "unsupported_duplicate_attribution"
SYNTHETIC_INSTRUCTION = "Summarize all three conversations in one concise paragraph."

#: Review sheets: the scale of each rating, and who is named as the reviewer.
RUBRIC = {
    "factual_error": "0 none, 1 minor, 2 major or fabricated",
    "person_error": "0 correct, 1 ambiguous, 2 wrong attribution",
    "omission": "0 no key omission, 1 minor omission, 2 core event omitted",
    "completeness": "1 poor to 5 accurate, complete, and concise",
}
REVIEW_IDENTITY = "human-AI collaborative evaluation"

#: Reason codes with severity and message, in the order of reporting.
REASONS = (
    ("empty_summary", "high", "The model returned an empty summary."),
    ("unsupported_person", "high", "The summary contains capitalized names or entities not found in the dialogue."),
    ("unsupported_number", "high", "The summary contains numbers, times, or amounts not found in the dialogue."),
    ("possible_number_omission", "medium", "Some dialogue numbers are absent from the summary; review whether they are important."),
    ("duplicate_event", "medium", "The summary may repeat the same event."),
    ("possible_attribution_conflict", "high", "Very similar events may be attributed to different speakers."),
    ("incomplete_sentence", "high", "The summary ends with an incomplete sentence."),
    ("input_truncated", "medium", "The input was truncated before generation."),
)
