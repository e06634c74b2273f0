"""Default word tables. Every operator also takes its own tables as parameters."""

from __future__ import annotations

# Topics that say nothing about a technology.
STOPWORDS = (
    "awesome", "list", "lists", "tool", "tools", "resource", "resources", "tutorial", "book", "course", "open-source", "hacktoberfest",
    "cli", "api", "sdk", "library", "framework", "platform", "cloud-native", "serverless", "real-time", "high-performance", "scalable",
    "production-ready", "enterprise", "example", "examples", "template", "boilerplate",
)

# Short forms of topics.
ALIASES = {
    "ai": "artificial-intelligence", "dl": "deep-learning", "ml": "machine-learning", "nlp": "natural-language-processing", "cv": "computer-vision",
    "genai": "generative-ai", "llm": "large-language-model", "llms": "large-language-model", "js": "javascript", "ts": "typescript",
    "node": "nodejs", "node-js": "nodejs", "reactjs": "react", "vuejs": "vue", "next": "nextjs", "next-js": "nextjs", "rn": "react-native",
    "k8s": "kubernetes", "tf": "tensorflow", "pt": "pytorch", "cv2": "opencv", "web-3": "web3",
}

# Categories in the order in which they are tried, and their keywords.
CATEGORIES = {
    "AI/ML Infrastructure": (
        "machine-learning", "deep-learning", "pytorch", "tensorflow", "keras", "neural-network", "training", "inference", "mlops", "automl",
        "scikit-learn", "model", "feature-store", "experiment-tracking",
    ),
    "Natural Language Processing": (
        "nlp", "natural-language-processing", "transformers", "bert", "text", "sentiment", "ner", "chatbot", "language-model", "tokenizer",
        "translation", "summarization",
    ),
    "Computer Vision": (
        "computer-vision", "opencv", "image", "object-detection", "yolo", "face", "segmentation", "ocr", "video", "pose", "cnn", "recognition",
    ),
    "Generative AI": (
        "large-language-model", "generative-ai", "stable-diffusion", "rag", "retrieval-augmented-generation", "ai-agents", "langchain", "fine-tuning",
        "lora", "prompt", "gpt", "diffusion", "vector-database", "embeddings",
    ),
    "Web Development": (
        "react", "vue", "angular", "nextjs", "svelte", "frontend", "ui", "components", "design-system", "css", "tailwindcss", "web", "spa", "ssr",
        "typescript", "javascript", "html",
    ),
    "Backend & APIs": (
        "api", "rest", "graphql", "backend", "fastapi", "django", "flask", "express", "microservices", "grpc", "server", "gateway", "middleware",
        "authentication", "nodejs",
    ),
    "Mobile Development": (
        "flutter", "react-native", "ios", "android", "swift", "kotlin", "mobile", "cross-platform", "dart", "swiftui", "jetpack-compose",
    ),
    "DevOps & Cloud": (
        "devops", "docker", "kubernetes", "ci-cd", "terraform", "ansible", "monitoring", "prometheus", "grafana", "gitops", "helm", "infrastructure",
        "cloud", "aws", "azure", "deployment",
    ),
    "Data Science": (
        "data-science", "pandas", "numpy", "visualization", "statistics", "analytics", "jupyter", "matplotlib", "seaborn", "etl", "data-pipeline",
        "forecasting", "time-series", "data-analysis",
    ),
    "Security": (
        "security", "vulnerability", "penetration-testing", "cryptography", "firewall", "encryption", "cybersecurity", "scanning", "compliance",
        "intrusion", "audit", "devsecops",
    ),
    "Blockchain & Web3": (
        "blockchain", "ethereum", "solidity", "smart-contracts", "web3", "defi", "nft", "crypto", "solana", "decentralized", "dao", "token", "dapp",
        "dex",
    ),
    "Game Development": (
        "game-development", "game-engine", "opengl", "vulkan", "unity", "godot", "unreal", "graphics", "rendering", "physics", "3d", "2d", "webgl",
        "gamedev",
    ),
    "Database & Storage": (
        "database", "sql", "nosql", "redis", "mongodb", "postgresql", "orm", "cache", "storage", "query", "replication", "graph-db", "key-value",
        "search", "index",
    ),
}


def category_rows() -> list[tuple[int, str, str]]:
    """(position, category, keyword) of the default categories."""
    return [(i, label, word) for i, (label, words) in enumerate(CATEGORIES.items()) for word in words]


def category_prompts() -> list[tuple[int, str, str]]:
    """(position, category, prompt): the text that describes a category to a text model."""
    return [(i, label, f"{label.lower()} repositories about {' '.join(words)}") for i, (label, words) in enumerate(CATEGORIES.items())]


# Short codes of labelled data and the categories they stand for.
CATEGORY_CODES = {
    "ai_ml": "AI/ML Infrastructure", "web_frontend": "Web Development", "web_backend": "Backend & APIs", "data_science": "Data Science", "devops": "DevOps & Cloud",
    "mobile": "Mobile Development", "security": "Security", "blockchain": "Blockchain & Web3", "nlp": "Natural Language Processing", "cv": "Computer Vision",
    "genai": "Generative AI", "database": "Database & Storage", "gamedev": "Game Development",
}
