"""Prompt templates in English and Chinese, with a check for missing values."""

from __future__ import annotations

import string

TEMPLATES: dict[str, dict[str, str]] = {
    "screen": {
        "en": "Question: {question}\n\nPassage ({citation}):\n{text}\n\nReply with JSON: summary (what the passage says about the question, or NOT_APPLICABLE) and relevance_score (0 to 10).",
        "zh": "问题：{question}\n\n片段（{citation}）：\n{text}\n\n请用 JSON 回复：summary（片段与问题有关的内容，无关则写 NOT_APPLICABLE）和 relevance_score（0 到 10）。",
    },
    "answer": {
        "en": "Question: {question}\n\nEvidence:\n{context}\n\nAnswer from the evidence alone and put the key of what you use in brackets, like (ev-01234567). If it doesn't suffice, write INSUFFICIENT_EVIDENCE.",
        "zh": "问题：{question}\n\n证据：\n{context}\n\n只根据证据作答，并在括号中写出所用证据的键，例如 (ev-01234567)。若证据不够，请写 INSUFFICIENT_EVIDENCE。",
    },
    "entry": {"en": "{key} {citation}: {summary}", "zh": "{key} {citation}：{summary}"},
    "title": {"en": "Give the title of the document that begins so:\n{text}", "zh": "下面是一篇文献的开头，请给出它的标题：\n{text}"},
    "query": {"en": "Rewrite as a literature search query: {question}", "zh": "请改写成文献检索词：{question}"},
}
ALIASES = {"en": "en", "english": "en", "zh": "zh", "zh-cn": "zh", "chinese": "zh", "中文": "zh"}


def render(name: str, language: str = "en", **values: str) -> str:
    """A filled template; an unknown language or a missing value is an error."""
    try:
        template = TEMPLATES[name][ALIASES[language.lower()]]
    except KeyError as error:
        raise ValueError(f"no template {name} in {language}") from error
    missing = {f for _, f, _, _ in string.Formatter().parse(template) if f} - set(values)
    if missing:
        raise ValueError(f"missing values: {sorted(missing)}")
    return template.format(**values)
