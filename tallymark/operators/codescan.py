"""Calls of model libraries in Python sources."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Provider, library, kind of call, calls (the end of a dotted name).
CALLS = (
    ("Multi-Provider", "litellm", "completion", "completion acompletion embedding aembedding image_generation aimage_generation"),
    ("OpenAI", "openai", "chat_completion", "chat.completions.create ChatCompletion.create Completion.create responses.create"),
    ("OpenAI", "openai", "completion", "completions.create"),
    ("OpenAI", "openai", "embedding", "embeddings.create"),
    ("OpenAI", "openai", "image_generation", "images.generate"),
    ("Azure OpenAI", "openai", "completion", "AzureOpenAI"),
    ("Anthropic", "anthropic", "completion", "messages.create completions.create"),
    ("Anthropic", "anthropic", "streaming", "messages.stream"),
    ("Google", "google", "completion", "generate_text generate_content generate_content_async"),
    ("Google", "vertexai", "completion", "predict predict_async"),
    ("Cohere", "cohere", "completion", "generate chat embed classify summarize rerank"),
    ("HuggingFace", "transformers", "completion", "pipeline AutoModelForCausalLM.from_pretrained AutoModelForSeq2SeqLM.from_pretrained generate"),
    ("HuggingFace", "huggingface_hub", "completion", "InferenceClient InferenceApi hf_hub_download text_generation chat_completion"),
    ("Multi-Provider", "langchain", "completion", "OpenAI ChatOpenAI Anthropic ChatAnthropic GooglePalm Cohere HuggingFaceHub Ollama predict invoke ainvoke run"),
    ("Multi-Provider", "llama_index", "completion", "OpenAI ChatOpenAI Anthropic PaLM complete chat stream_complete"),
    ("Replicate", "replicate", "completion", "replicate.run client.run models.get"),
    ("Together", "together", "completion", "Complete.create Chat.create Embedding.create Image.create completions.create embeddings.create"),
    ("Ollama", "ollama", "completion", "generate chat embeddings"),
    ("AWS Bedrock", "boto3", "completion", "invoke_model invoke_model_with_response_stream"),
    ("Mistral", "mistralai", "completion", "MistralClient chat chat.complete embeddings chat_stream"),
    ("AI21", "ai21", "completion", "Completion.execute Chat.execute Summarize.execute complete chat"),
)
# Providers that are told by the address given to another one's library.
ADDRESSES = (("Anyscale", "openai", "completion", "anyscale"), ("Perplexity", "openai", "completion", "perplexity"), ("AWS Bedrock", "boto3", "completion", "bedrock-runtime"))
_HIT = "file string, line int, function string, provider string, library string, call_type string, prompt string, confidence string, notes string"


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "")
    return ".".join(reversed(parts))


def prompt_of(node: ast.AST | None, names: dict[str, ast.AST]) -> tuple[str, str, str]:
    """(text, confidence, notes) of a prompt argument: literals are told, f-strings and
    templates with their holes, names and calls followed where that can be."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value, "high", ""
    if isinstance(node, ast.JoinedStr):
        return "".join(v.value if isinstance(v, ast.Constant) else "{" + ast.unparse(v.value) + "}" for v in node.values), "medium", "f-string"
    if isinstance(node, (ast.List, ast.Tuple)):
        found = [prompt_of(x, names) for x in node.elts]
        return "\n".join(t for t, _, _ in found if t), "medium", "; ".join(dict.fromkeys(n for *_, n in found if n)) or "list of messages"
    if isinstance(node, ast.Dict):
        for k, v in zip(node.keys, node.values):
            if isinstance(k, ast.Constant) and k.value == "content":
                return prompt_of(v, names)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        a, b = prompt_of(node.left, names), prompt_of(node.right, names)
        return a[0] + b[0], "low" if "low" in (a[1], b[1]) else "medium", "concatenation"
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod):
        text, sure, _ = prompt_of(node.left, names)
        return text, "medium" if sure == "high" else sure, "format with %"
    if isinstance(node, ast.Call):
        if isinstance(node.func, ast.Attribute) and node.func.attr in ("format", "format_map", "strip", "join", "replace"):
            text, sure, _ = prompt_of(node.func.value, names)
            return text, "medium" if sure == "high" else sure, f"{node.func.attr}() of a text"
        return ast.unparse(node), "low", f"result of {_dotted(node.func) or 'a call'}()"
    if isinstance(node, ast.Name):
        if node.id in names:
            text, sure, _ = prompt_of(names[node.id], {k: v for k, v in names.items() if k != node.id})
            return text, "medium" if sure == "high" else sure, f"variable {node.id}"
        return node.id, "low", f"variable {node.id} not found"
    if isinstance(node, ast.Attribute):
        own = names.get(node.attr)
        if own is not None:
            text, sure, _ = prompt_of(own, {k: v for k, v in names.items() if k != node.attr})
            return text, "low" if sure == "low" else "medium", f"attribute {_dotted(node)}"
        return ast.unparse(node), "low", f"attribute {_dotted(node)}"
    return (ast.unparse(node) if node is not None else ""), "low", "no prompt argument" if node is None else "expression"


def calls_in(file: str, text: str) -> list[tuple]:
    """A row for each call whose library the file imports; once for each line and call."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    imported: set[str] = set()
    names: dict[str, ast.AST] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imported |= {a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            imported.add(node.module.split(".")[0])
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, (ast.Name, ast.Attribute)):
                    names[t.id if isinstance(t, ast.Name) else t.attr] = node.value
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and node.value is not None:
            names[node.target.id] = node.value
    here = [(p, lib, kind, calls.split()) for p, lib, kind, calls in CALLS if any(i == lib or i.startswith(f"{lib}_") for i in imported)]
    out, seen = [], set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            called = _dotted(node.func)
            root = called.split(".")[0]  # a module that is imported answers for itself
            own = [x for x in enumerate(here) if root not in imported or root == x[1][1] or root.startswith(f"{x[1][1]}_")]
            best = max(((len(c), -k, p, lib, kind) for k, (p, lib, kind, calls) in own for c in calls if called == c or called.endswith(f".{c}")), default=None)
            if best and (node.lineno, called) not in seen:
                seen.add((node.lineno, called))
                provider, library, kind = best[2:]
                for p, lib, _, word in ADDRESSES:
                    if lib == library and any(k.arg in ("base_url", "api_base", "endpoint_url") and word in ast.unparse(k.value) for k in node.keywords):
                        provider = p
                arg = next((k.value for k in node.keywords if k.arg in ("messages", "prompt", "input", "contents", "message", "inputs")), node.args[0] if node.args else None)
                out.append((file, node.lineno, called, provider, library, kind, *prompt_of(arg, names)))
    return out


def scan_calls(files: DataFrame) -> DataFrame:
    """Calls in files of ``file, text``; sources that do not parse give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for r in calls_in(f, t)]
            kinds = [pa.string(), pa.int32()] + [pa.string()] * 7
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _HIT.split(", ")])

    return files.select("file", "text").mapInArrow(run, _HIT)


def call_patterns() -> list[tuple[str, str]]:
    """(provider and kind, regular expression) of CALLS and ADDRESSES, for sources that do not parse."""
    out: dict[str, list[str]] = {}
    for provider, _, kind, calls in CALLS:
        out.setdefault(f"{provider}/{kind}", []).extend(re.escape(c) + r"\s*\(" for c in calls.split())
    for provider, _, kind, word in ADDRESSES:
        out.setdefault(f"{provider}/{kind}", []).append(re.escape(word))
    return [(k, "(?<![A-Za-z0-9_])(?:" + "|".join(v) + ")") for k, v in out.items()]


def one_for_line(hits: DataFrame, rank: str) -> DataFrame:
    """Of hits with one ``file, line, function`` that of the least ``rank``."""
    rest = [c for c in hits.columns if c not in ("file", "line", "function")]
    return hits.groupBy("file", "line", "function").agg(F.min(F.struct(rank, *[c for c in rest if c != rank])).alias("f")).select("file", "line", "function", "f.*")


def top_files(hits: DataFrame, n: int = 20) -> DataFrame:
    """The files with most hits."""
    return hits.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(n)


def first_hits(hits: DataFrame, n: int = 50) -> DataFrame:
    return hits.orderBy("file", "line").limit(n)


def scan_lines(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``file, line, text, name`` of every line that matches a pattern (``name, regex``).

    The patterns are part of the plan: a list of rules that somebody wrote.
    """
    rules = patterns.select("name", "regex").orderBy("name").collect()
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(r.regex), F.lit(r.name)) for r in rules])) if rules else F.expr("CAST(array() AS ARRAY<STRING>)")
    return lines.select("file", "line", "text", F.explode(hits).alias("name"))
