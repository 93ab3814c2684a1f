"""Word lists of the industry-news operators (fixed values)."""

SUMMARY_LIMIT, TITLE_LIMIT, SOURCE_LIMIT = 220, 150, 40
FEED_ITEMS, RELEASE_ITEMS, LISTED_ITEMS = 4, 2, 4
SELECTED_ITEMS, PER_SOURCE, REGION_ITEMS = 9, 2, 3
DOMESTIC_REGION = "国内"
RESERVED_SOURCES = ("OpenAI", "Anthropic", "Google AI")
PUBLISHERS = (
    "openai.com", "anthropic.com", "blog.google", "nvidia.com", "huggingface.co", "infoq.cn", "qbitai.com",
    "jiqizhixin.com", "qwenlm.github.io", "deepseek.com",
)
MEDIA_SOURCES = ("InfoQ 中文", "量子位", "机器之心")
READ_MORE = r"(?:点击|点开)?(?:查看|阅读)原文[>→↗\s]*"
EMPTY_SUMMARIES = ("查看来源发布的最新 AI 动态与完整信息。", "查看 DeepSeek 官方发布的模型与产品动态。")
CATEGORIES = (
    ("模型升级", ("release", "version", "model", "模型", "升级", "gpt", "gemini", "claude", "qwen", "llama", "deepseek")),
    ("开源生态", ("github", "open source", "open-source", "开源", "framework", "library", "sdk")),
    (
        "行业应用",
        (
            "医疗", "制造", "教育", "金融", "零售", "汽车", "行业", "industry", "health", "manufactur", "enterprise",
            "science", "societal", "workforce",
        ),
    ),
    ("产品动态", ("launch", "product", "agent", "api", "发布", "产品", "智能体")),
)
