"""Who made a model and who served it: canonical providers, tags, and what a model's name tells.

All are column expressions over fixed tables; use them on distinct spellings and join the result back."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a provider, by its canonical name.
SPELLINGS = {
    "xai": "x_ai xai xai_oauth grok grok_oauth grok_cli supergrok",
    "zai": "z_ai zai zhipu zhipuai zhipu_ai zhipu_coding_plan bigmodel bigmodel_cn open_bigmodel_cn",
    "kimi": "moonshot moonshotai moonshot_ai moonshot_coding_plan kimi kimi_code kimi_for_coding kimi_coding_plan",
    "xiaomi": "xiaomi mimo",
    "meituan": "meituan longcat",
    "doubao": "doubao",
    "tencent": "tencent tecent tencent_cloud hunyuan hy3 hy3_preview",
    "baidu": "baidu qianfan wenxin",
    "baichuan": "baichuan baichuan_ai",
    "01-ai": "01ai 01_ai zeroone zero_one zero_one_ai lingyiwanwu",
    "meta": "meta meta_llama",
    "microsoft": "microsoft azure azure_ai github_copilot copilot_chat",
    "anthropic": "anthropic",
    "together": "together together_ai",
    "fireworks": "fireworks fireworks_ai",
    "google": "google gemini vertex vertex_ai google_vertex google_gemini_cli google_antigravity",
    "openai": "openai openai_codex openai_native openai_pro chatgpt",
    "opencode": "opencode",
    "openrouter": "openrouter",
    "bedrock": "bedrock",
    "aws": "aws amazon",
    "groq": "groq",
    "cohere": "cohere",
    "perplexity": "perplexity",
    "commandcode": "commandcode command_code",
    "unisound": "unisound uni_sound yunzhisheng yun_zhi_sheng",
    "minimax": "minimax minimaxai minimax_ai",
    "mistral": "mistral mistralai",
    "deepseek": "deepseek deepseek_official pandora_deepseek deepseek_ai",
    "qwen": "qwen qwen_portal",
    "ai21": "ai21 ai21labs ai21_labs",
}
# How other spellings begin (or, in braces, what they contain), tried in this order.
BEGINNINGS = [
    ("xai", "xai|grok"), ("zai", "zai|z_ai|zhipu|bigmodel|open_bigmodel"), ("xiaomi", "xiaomi"), ("minimax", "minimax"), ("kimi", "moonshot"), ("qwen", "qwen"), ("meituan", "meituan|longcat"),
    ("stepfun", ".*stepfun"), ("doubao", "doubao"), ("tencent", "hunyuan"), ("baichuan", "baichuan"), ("alibaba", "alibaba"), ("tencent", "tencent|tecent"), ("baidu", "baidu|qianfan|wenxin"),
    ("opencode", "opencode_"), ("microsoft", "github_cop|.*copilot"), ("unisound", "unisound|uni_sound|yunzhisheng|yun_zhi_sheng"),
]
# What a model's name holds, by maker, tried in this order: parts of the whole name, words of it
# (no letter or digit beside them), and patterns of its last segment.
MODEL_NAMES = [
    ("deepseek", "", "", "model1|model2"), ("anthropic", "", "", "claude-opus-5(-.+)?"), ("unisound", "", "", "u2"),
    ("zai", "glm zhipu z-ai z.ai", "", ""), ("xiaomi", "mimo xiaomi", "", ""), ("kimi", "kimi moonshot", "", "k3([-._].*)?"), ("meituan", "longcat meituan", "", ""),
    ("tencent", "", "hunyuan hy3", ""), ("doubao", "", "doubao", ""), ("baidu", "", "ernie qianfan wenxin", ""), ("baichuan", "", "baichuan", "baichuan.*"), ("01-ai", "", "01-ai 01.ai 01_ai", "yi[-_].*"),
    ("anthropic", "", "", r"(?:(?:.*\.)?anthropic\.)?(?:claude|opus|sonnet|haiku|fable)-.*"),
    ("openai", "gpt openai text-embedding dall-e whisper", "codex tts o1 o3 o4", ""), ("google", "gemini google", "", ""), ("xai", "grok", "", "composer([-._].*)?"), ("deepseek", "deepseek", "", ""), ("minimax", "minimax", "", ""),
    ("cohere", "", "cohere", "command-(?:r|a|light|nightly|xlarge|medium)([-._].*)?|c4ai-aya([-._].*)?"), ("ai21", "", "jamba ai21", "(?:j2|jurassic)-.*"), ("perplexity", "", "perplexity", "sonar(-.*)?"),
    ("mistral", "mistral mixtral", "", ""), ("meta", "llama", "meta", ""), ("qwen", "qwen", "", "q[wv]q(-.*)?"), ("stepfun", "stepfun", "", "step-[123]([-._].*)?"),
]
# Makers that views show as a family of models.
FAMILIES = {"openai": "gpt", "anthropic": "claude", "google": "gemini", "xai": "xai", "zai": "glm", "deepseek": "deepseek", "qwen": "qwen", "kimi": "kimi", "minimax": "minimax", "xiaomi": "mimo", "mistral": "mistral"}


def _escaped(words: str) -> str:
    return "|".join(w.replace(".", r"\.") for w in words.split())


def last_segment(model: Column) -> Column:
    return F.coalesce(F.element_at(F.filter(F.split(F.lower(F.trim(model)), "/"), lambda s: s != ""), -1), F.lit(""))


def inferred(model: Column) -> Column:
    """The maker that a model's name tells, or null."""
    lower, last, out = F.lower(model), last_segment(model), F.lit(None).cast("string")
    for maker, parts, words, shape in reversed(MODEL_NAMES):
        tests = [lower.rlike(_escaped(parts))] if parts else []
        tests += [lower.rlike(f"(?<![a-z0-9])(?:{_escaped(words)})(?![a-z0-9])")] if words else []
        tests += [last.rlike(f"^(?:{shape})$")] if shape else []
        out = F.when(reduce(lambda a, b: a | b, tests), maker).otherwise(out)
    return out


def family(model: Column) -> Column:
    maker, out = inferred(model), F.lit("unknown")
    for name, shown in FAMILIES.items():
        out = F.when(maker == name, shown).otherwise(out)
    return out


def _exact() -> Column:
    return F.create_map(*[F.lit(x) for name, words in SPELLINGS.items() for w in words.split() for x in (w, name)])


def segment_provider(segment: Column) -> Column:
    """The canonical provider that one part of a provider's path names, or null."""
    bare = F.regexp_replace(F.trim(segment), "/+$", "")
    key = F.regexp_replace(F.lower(bare), r"[-.\s]", "_")
    out = F.lit(None).cast("string")
    for name, shape in reversed(BEGINNINGS):
        out = F.when(key.rlike(f"^(?:{shape})"), name).otherwise(out)
    known = F.coalesce(F.try_element_at(_exact(), bare), F.try_element_at(_exact(), key))
    return F.when(bare.rlike("^<.*>$"), F.lit(None)).when(known.isNotNull(), known).when(key.rlike("[0-9]") | (key == "") | (key == "unknown"), F.lit(None)).otherwise(out)


def _parts(raw: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(raw), "/+$", ""), "/"), lambda s: F.trim(s))


def _named(segment: Column) -> Column:
    """The providers that a segment names: itself, or its parts between dots."""
    whole = segment_provider(segment)
    dotted = F.filter(F.transform(F.split(segment, r"\."), segment_provider), lambda x: x.isNotNull())
    return F.when(whole.isNotNull(), F.array(whole)).when(segment.contains("."), dotted).otherwise(F.array().cast("array<string>"))


def canonical_provider(raw: Column) -> Column:
    """The first canonical provider that a path names, or null."""
    return F.get(F.flatten(F.transform(_parts(raw), _named)), 0)


def _literal(segment: Column) -> Column:
    bare = F.regexp_replace(F.trim(segment), "/+$", "")
    return F.when((bare != "") & (F.lower(bare) != "unknown") & ~bare.rlike("^<.*>$") & ~bare.rlike("[0-9]"), F.lower(bare))


def provider_tags(raw: Column) -> Column:
    """All providers that a path names: canonical ones, and other segments without digits as they are."""
    def tags(s: Column) -> Column:
        return F.when(F.size(_named(s)) > 0, _named(s)).otherwise(F.filter(F.array(_literal(s)), lambda x: x.isNotNull()))

    return F.array_distinct(F.flatten(F.transform(_parts(raw), tags)))


def key_tags(key: Column) -> Column:
    """The providers that a catalog key names: its segments, and the last one's parts between dots; none for a bare key."""
    parts = F.split(key, "/")
    own = F.flatten(F.transform(F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.split(F.element_at(parts, -1), r"\.")), provider_tags))
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(own))


def grouped_provider(raw: Column) -> Column:
    """How providers are grouped: owl, the canonical name, or the literal one in lower case."""
    bare = F.trim(raw)
    owl = F.lower(bare).rlike("(?<![a-z0-9])owlc?(?![a-z0-9])")
    return F.when(owl, "owl").otherwise(F.coalesce(canonical_provider(bare), F.lower(F.regexp_replace(bare, "/+$", ""))))


def provider_scope(provider: Column, model: Column) -> Column:
    """Whose prices count: the provider that was observed (of a GPT route its owner), else the model's maker, or null."""
    seen = F.trim(provider)
    routed = F.when(F.lower(model).startswith("gpt-") & seen.contains("/"), F.substring_index(seen, "/", 1)).otherwise(seen)
    return F.when((seen != "") & (F.lower(seen) != "unknown"), routed).otherwise(inferred(model))


def finalized_provider(provider: Column, model: Column) -> Column:
    """The provider of a record: what the model's name forces, the canonical one, the literal one, the model's maker, or unknown."""
    raw, maker = F.trim(F.coalesce(provider, F.lit(""))), inferred(model)
    canonical, last = canonical_provider(raw), last_segment(model)
    forced = F.when(last.isin("model1", "model2"), "deepseek").when(last.rlike("^claude-opus-5(-.+)?$"), "anthropic")
    foreign = F.when(maker.isNull() | (maker == "anthropic"), "unknown").otherwise(maker)
    claude = last.rlike(f"^(?:{MODEL_NAMES[12][3]})$")
    literal = F.get(F.filter(F.transform(F.filter(_parts(raw), lambda s: F.size(_named(s)) == 0), _literal), lambda x: x.isNotNull()), 0)
    owl = F.lower(raw).rlike("(?<![a-z0-9])owlc?(?![a-z0-9])")
    return F.when(owl, "owl").otherwise(F.coalesce(forced, F.when(canonical == "commandcode", canonical).when((canonical == "anthropic") & ~claude, foreign), canonical, literal, maker, F.lit("unknown")))
