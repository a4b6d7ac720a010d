"""The provider dimension: which service a target address belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import literal_rows

# Id, name, address, category. Entries without an address are for search only.
PROVIDERS = (
    ("openai", "OpenAI", "https://api.openai.com", "foundation"),
    ("anthropic", "Anthropic", "https://api.anthropic.com", "foundation"),
    ("gemini", "Google Gemini", "https://generativelanguage.googleapis.com", "foundation"),
    ("xai", "xAI (Grok)", "https://api.x.ai", "foundation"),
    ("deepseek", "DeepSeek", "https://api.deepseek.com", "foundation"),
    ("mistral", "Mistral AI", "https://api.mistral.ai", "foundation"),
    ("cohere", "Cohere", "https://api.cohere.com", "foundation"),
    ("nvidia", "NVIDIA NIM", "https://integrate.api.nvidia.com", "foundation"),
    ("qwen", "Qwen (Alibaba)", "https://dashscope.aliyuncs.com/compatible-mode", "foundation"),
    ("kimi", "Kimi (Moonshot)", "https://api.moonshot.cn", "foundation"),
    ("zhipu", "Zhipu AI (GLM)", "https://open.bigmodel.cn/api/paas", "foundation"),
    ("meta", "Meta AI (Llama)", "https://api.llama.com", "foundation"),
    ("openrouter", "OpenRouter", "https://openrouter.ai/api", "infra"),
    ("groq", "Groq", "https://api.groq.com/openai", "infra"),
    ("together", "Together AI", "https://api.together.xyz", "infra"),
    ("fireworks", "Fireworks AI", "https://api.fireworks.ai/inference", "infra"),
    ("huggingface", "Hugging Face", "https://api-inference.huggingface.co", "infra"),
    ("deepinfra", "DeepInfra", "https://api.deepinfra.com/v1/openai", "infra"),
    ("siliconflow", "SiliconFlow", "https://api.siliconflow.cn", "infra"),
    ("azure", "Azure OpenAI", "", "infra"),
    ("bedrock", "AWS Bedrock", "", "infra"),
    ("perplexity", "Perplexity", "https://api.perplexity.ai", "specialized"),
    ("cerebras", "Cerebras", "https://api.cerebras.ai", "specialized"),
    ("ollama", "Ollama", "http://localhost:11434", "local"),
    ("lmstudio", "LM Studio", "http://localhost:1234/v1", "local"),
    ("llamacpp", "Llama.cpp", "http://localhost:8080", "local"),
    ("localai", "LocalAI", "http://localhost:8080/v1", "local"),
    ("vllm", "vLLM", "http://localhost:8000/v1", "local"),
    ("oobabooga", "Text Gen WebUI", "http://localhost:5000/v1", "local"),
    ("gpt4all", "GPT4All", "http://localhost:4891/v1", "local"),
    ("jan", "Jan", "http://localhost:1337/v1", "local"),
    ("koboldcpp", "Kobold.cpp", "http://localhost:5001", "local"),
    ("anythingllm", "AnythingLLM", "http://localhost:3001/api", "local"),
    ("msty", "Msty", "http://localhost:10101", "local"),
    ("openwebui", "Open WebUI", "http://localhost:3000", "local"),
    ("openclaw", "OpenClaw", "", "agents"),
    ("agentzero", "Agent Zero", "", "agents"),
    ("custom", "Custom", "", "custom"),
    ("n8n", "n8n", "", "automation"),
    ("make", "Make (Integromat)", "https://hook.make.com", "automation"),
    ("zapier", "Zapier", "https://hooks.zapier.com", "automation"),
    ("activepieces", "Activepieces", "", "automation"),
    ("nodered", "Node-RED", "http://localhost:1880", "automation"),
    ("pipedream", "Pipedream", "https://eo.pipedream.net", "automation"),
    ("gumloop", "Gumloop", "https://api.gumloop.com", "automation"),
)
# Fixed value: the address the service side lists for this entry.
SERVICE_ADDRESS = {"llamacpp": "http://localhost:20979"}
# The categories with entries the service side lists, and the ones it leaves out of them.
SERVICE_CATEGORIES = ("foundation", "infra", "specialized", "local")
SERVICE_ABSENT = (
    "azure", "bedrock", "localai", "oobabooga", "gpt4all", "jan", "koboldcpp", "anythingllm", "msty", "openwebui",
)
# Category labels.
CATEGORIES = {
    "foundation": "Foundation Models",
    "infra": "API Gateways",
    "specialized": "Specialized",
    "local": "Local / Self-Hosted",
    "agents": "Agent Frameworks",
    "automation": "Automation Platforms",
    "custom": "Other",
}
UNKNOWN = "custom"


def providers(spark: SparkSession, service: bool = False) -> DataFrame:
    """The catalog (id, name, url, category, category_label); ``service`` gives the shorter service-side list."""
    rows = PROVIDERS
    if service:
        rows = [
            (id_, name, SERVICE_ADDRESS.get(id_, url), category)
            for id_, name, url, category in PROVIDERS
            if category in SERVICE_CATEGORIES and id_ not in SERVICE_ABSENT
        ]
    return literal_rows(
        spark, [(*row, CATEGORIES[row[3]]) for row in rows], ["id", "name", "url", "category", "category_label"]
    )


def with_provider(df: DataFrame, target: str = "target", catalog: DataFrame | None = None) -> DataFrame:
    """Adds provider and provider_category by exact target address; ``custom`` where none fits.

    The built-in catalog is a fixed list of under 50 rows and is broadcast; a catalog of the caller's is
    joined as Spark sees fit.
    """
    own = catalog is not None
    dim = catalog if own else providers(df.sparkSession)
    dim = dim.filter("url != ''").select(
        F.col("url").alias("_url"), F.col("id").alias("_id"), F.col("category").alias("_category")
    )
    joined = df.join(dim if own else F.broadcast(dim), F.col(target) == F.col("_url"), "left")
    return joined.withColumns(
        {
            "provider": F.coalesce("_id", F.lit(UNKNOWN)),
            "provider_category": F.coalesce("_category", F.lit(UNKNOWN)),
        }
    ).drop("_url", "_id", "_category")


def search_providers(catalog: DataFrame, query: str) -> DataFrame:
    """Catalog rows whose name contains the query, ignoring case and surrounding blanks."""
    return catalog.filter(F.lower("name").contains(query.lower().strip()))
