"""Technology stacks from manifests: names, markers and declared dependencies."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text
from loomgraph.operators.resolve import dependency_signals
from loomgraph.plans.schema import first_rows

MOST_BYTES, MOST_DEPTH = 512_000, 3

# What a file name proves.
MANIFESTS = (
    ("package.json", "Node.js", "runtime"),
    ("pyproject.toml", "Python", "runtime"),
    ("requirements.txt", "Python", "runtime"),
    ("Pipfile", "Python", "runtime"),
    ("setup.py", "Python", "runtime"),
    ("go.mod", "Go", "runtime"),
    ("Cargo.toml", "Rust", "runtime"),
    ("pom.xml", "Maven", "build"),
    ("build.gradle", "Gradle", "build"),
    ("build.gradle.kts", "Gradle", "build"),
    ("Gemfile", "Ruby", "runtime"),
    ("composer.json", "PHP / Composer", "runtime"),
    ("build.sbt", "sbt (Scala)", "build"),
    ("Package.swift", "Swift Package Manager", "build"),
    ("CMakeLists.txt", "CMake", "build"),
    ("Makefile", "Make", "build"),
    ("Dockerfile", "Docker", "infra"),
    ("docker-compose.yml", "Docker Compose", "infra"),
    ("docker-compose.yaml", "Docker Compose", "infra"),
    ("Chart.yaml", "Helm", "infra"),
    ("Vagrantfile", "Vagrant", "infra"),
    ("Procfile", "Procfile deploy", "infra"),
    ("netlify.toml", "Netlify", "infra"),
    ("vercel.json", "Vercel", "infra"),
    ("render.yaml", "Render", "infra"),
    ("fly.toml", "Fly.io", "infra"),
    ("serverless.yml", "Serverless Framework", "infra"),
    ("package-lock.json", "npm", "package-manager"),
    ("yarn.lock", "Yarn", "package-manager"),
    ("pnpm-lock.yaml", "pnpm", "package-manager"),
    ("poetry.lock", "Poetry", "package-manager"),
    ("uv.lock", "uv", "package-manager"),
    ("Cargo.lock", "Cargo", "package-manager"),
    ("Gemfile.lock", "Bundler", "package-manager"),
)

# What a folder (or a file of that name) proves.
MARKERS = (
    (".github/workflows", "GitHub Actions", "ci"),
    (".gitlab-ci.yml", "GitLab CI", "ci"),
    (".circleci", "CircleCI", "ci"),
    ("k8s", "Kubernetes", "infra"),
    ("kubernetes", "Kubernetes", "infra"),
    ("migrations", "Database migrations", "database"),
    ("terraform", "Terraform", "infra"),
)

# What a declared dependency proves; earlier ones win among prefixes.
SIGNALS = (
    ("react", "React", "framework"),
    ("next", "Next.js", "framework"),
    ("vue", "Vue", "framework"),
    ("nuxt", "Nuxt", "framework"),
    ("svelte", "Svelte", "framework"),
    ("@angular/core", "Angular", "framework"),
    ("express", "Express", "framework"),
    ("fastify", "Fastify", "framework"),
    ("nestjs", "NestJS", "framework"),
    ("@nestjs/core", "NestJS", "framework"),
    ("electron", "Electron", "framework"),
    ("vite", "Vite", "build"),
    ("webpack", "webpack", "build"),
    ("jest", "Jest", "build"),
    ("prisma", "Prisma", "database"),
    ("typeorm", "TypeORM", "database"),
    ("mongoose", "Mongoose / MongoDB", "database"),
    ("pg", "PostgreSQL client", "database"),
    ("django", "Django", "framework"),
    ("flask", "Flask", "framework"),
    ("fastapi", "FastAPI", "framework"),
    ("starlette", "Starlette", "framework"),
    ("tornado", "Tornado", "framework"),
    ("sqlalchemy", "SQLAlchemy", "database"),
    ("psycopg", "PostgreSQL client", "database"),
    ("psycopg2", "PostgreSQL client", "database"),
    ("pymongo", "MongoDB client", "database"),
    ("redis", "Redis client", "database"),
    ("celery", "Celery", "framework"),
    ("pandas", "pandas", "framework"),
    ("numpy", "NumPy", "framework"),
    ("torch", "PyTorch", "framework"),
    ("tensorflow", "TensorFlow", "framework"),
    ("scikit-learn", "scikit-learn", "framework"),
    ("transformers", "Hugging Face Transformers", "framework"),
    ("langchain", "LangChain", "framework"),
    ("pytest", "pytest", "build"),
    ("github.com/gin-gonic/gin", "Gin", "framework"),
    ("github.com/labstack/echo", "Echo", "framework"),
    ("github.com/gofiber/fiber", "Fiber", "framework"),
    ("actix-web", "Actix Web", "framework"),
    ("axum", "Axum", "framework"),
    ("rocket", "Rocket", "framework"),
    ("tokio", "Tokio", "framework"),
    ("serde", "Serde", "framework"),
    ("rails", "Ruby on Rails", "framework"),
    ("sinatra", "Sinatra", "framework"),
    ("laravel/framework", "Laravel", "framework"),
    ("symfony/symfony", "Symfony", "framework"),
    ("org.springframework.boot", "Spring Boot", "framework"),
    ("spring-boot-starter", "Spring Boot", "framework"),
)


def _json_keys(content: Column, *sections: str) -> Column:
    """Keys of the sections of a JSON manifest; a bad one has none."""
    maps = (F.map_keys(F.from_json(F.get_json_object(content, f"$.{s}"), "map<string,string>")) for s in sections)
    return F.concat(*(F.coalesce(m, F.array().cast("array<string>")) for m in maps))


def _table(value: object, *keys: str) -> dict:
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}


def toml_dependencies(content: str) -> list[str]:
    """Dependencies that a pyproject or a Cargo manifest declares; a bad one has none."""
    try:
        whole = tomllib.loads(content)
    except (tomllib.TOMLDecodeError, RecursionError):
        return []
    lists = [whole["project"].get("dependencies")] if isinstance(whole.get("project"), dict) else []
    lists += _table(whole, "project", "optional-dependencies").values()
    required = [x for found in lists if isinstance(found, list) for x in found if isinstance(x, str)]
    poetry = _table(whole, "tool", "poetry")
    tables = [_table(poetry, "dependencies"), _table(poetry, "dev-dependencies"), *(_table(g, "dependencies") for g in _table(poetry, "group").values())]
    tables += [_table(whole, "dependencies"), _table(whole, "dev-dependencies")]
    return [re.split(r"[<>=!\[~; ]", x, maxsplit=1)[0] for x in required] + [k for t in tables for k in t]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _toml_names(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else toml_dependencies(c))


def dependencies_of(name: Column, content: Column) -> Column:
    """Declared dependencies of one manifest, by its file name."""
    listed = F.filter(F.transform(F.split(content, "\r?\n"), F.trim), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-"))
    all_of = lambda pattern: F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    found = (
        F.when(name == "package.json", _json_keys(content, "dependencies", "devDependencies", "peerDependencies"))
        .when(name == "composer.json", _json_keys(content, "require", "require-dev"))
        .when(name == "requirements.txt", F.transform(listed, text.requirement_name))
        .when(name.isin("pyproject.toml", "Cargo.toml"), _toml_names(F.when(name.isin("pyproject.toml", "Cargo.toml"), content)))
        .when(name == "go.mod", all_of(r"(?m)^\s*(?:require\s+)?([\w./-]+)\s+v\d"))
        .when(name == "Gemfile", all_of(r"""(?m)^\s*gem\s+["']([^"']+)["']"""))
    )
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x != "")


def detect(scan: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(name, category, evidence, detail), the first evidence of each (name, category) by path.

    ``scan``: a repository scan; deeper files than ``most_depth`` path parts
    and contents over ``MOST_BYTES`` are not read."""
    spark = scan.sparkSession
    files = scan.where(F.size(F.split("path", "/")) <= most_depth)
    manifests = spark.createDataFrame(list(MANIFESTS), "name string, stack string, category string")
    markers = spark.createDataFrame(list(MARKERS), "marker string, stack string, category string")
    signals = spark.createDataFrame([(*x, k) for k, x in enumerate(SIGNALS)], "signal string, framework string, category string, ordinal int")

    named = files.join(manifests, "name").select(F.col("stack").alias("name"), "category", F.col("path").alias("evidence"), F.lit("").alias("detail"))
    # any file of Terraform's, by its suffix
    terraform = files.where("name like '_%.tf'").select(F.lit("Terraform").alias("name"), F.lit("infra").alias("category"), F.col("path").alias("evidence"), F.lit("").alias("detail"))
    # each folder above a file, and the file itself, by all of its suffixes
    parts = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("at"), (k == F.size(parts)).alias("is_file")))).alias("a")).select("a.*").distinct()
    of = F.split("at", "/")
    ends = F.when(F.col("is_file"), F.array("at")).otherwise(F.transform(F.sequence(F.lit(1), F.size(of)), lambda k: F.array_join(F.slice(of, k, F.size(of)), "/")))
    marked = above.withColumn("marker", F.explode(ends)).join(markers, "marker").select(F.col("stack").alias("name"), "category", F.col("at").alias("evidence"), F.lit("").alias("detail"))
    declared = files.where((F.col("size") <= MOST_BYTES) & F.col("content").isNotNull())
    declared = declared.select("path", F.explode(dependencies_of(F.col("name"), F.col("content").try_cast("string"))).alias("name"))
    proved = dependency_signals(declared.distinct(), signals).select(F.col("framework").alias("name"), "category", F.col("path").alias("evidence"), F.col("name").alias("detail"))
    return first_rows(named.unionByName(terraform).unionByName(marked).unionByName(proved), ["name", "category"], [F.col("evidence"), F.col("detail")])


def by_category(detections: DataFrame) -> DataFrame:
    return detections.groupBy("category").agg(F.sort_array(F.collect_set("name")).alias("names"))
