"""Settings: fixed vocabularies and thresholds, and their loading from YAML."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

# Word lists, weights and thresholds that results depend on.
POSITIONS = "远方 就地 并列 解列 分闸 合闸 投入 退出 信号 跳闸".split()
OBJECTS = "电气位置指示 机械位置指示 位置指示 负荷转移指示 电压三相指示 三相指示 电流指示 电压指示 潮流指示 相指示".split()
HANDLES = "操作方式把手 电压并列把手 同期把手 远方就地把手 切换把手 把手 压板 空开 空气开关".split()
ACTIONS = "切至 拉开 合上 断开 投入 退出 取下 装上 解锁 闭锁 送电 停电 复归".split()
CHECKS = "检查 核对 确认 验明".split()
PANELS = "测控屏 保护屏 主控屏 中央信号屏 直流屏 端子箱 机构箱 汇控柜 后台机 监控后台".split()
STATES = "确已 已经 正确 良好 符合 无误".split()
SUFFIXES = "隔离开关 接地刀闸 接地开关 断路器 开关 刀闸 熔断器 段母线 母线 线路 主变 变压器 电容器 电抗器 消弧线圈 站用变".split()
PREFIX_CHARS = "桥母联分段旁路主副内外正备用号段甲乙丙丁东西南北上下前后左右"
STOPWORDS = "将 把 由 至 到 的 了 位置 状态 系统 条件 及 和 与".split()
SWITCH_VERBS = "切至 切换至 改至 改为 置于 投至 打至 放至 切到".split()
SLOT_WEIGHTS = {"voltage": 1.0, "device": 2.0, "handle": 1.5, "object": 2.0, "src_position": 1.5, "dst_position": 2.0, "action": 1.5, "check_type": 1.0, "panel": 0.5, "state": 0.3, "residual": 1.0}
REQUIRED = ("voltage", "device", "handle", "object", "src_position", "dst_position", "action")
EXACT_DIGITS = ("voltage", "device", "handle")
DISCRIMINATIVE = ("object", "check_type", "src_position", "dst_position", "handle")
DIALECT = {
    "initials": [["z", "zh"], ["c", "ch"], ["s", "sh"], ["l", "n"], ["y", "r"]],
    "finals": [["in", "ing"], ["en", "eng"], ["an", "ang"]],
    "syllables": [["fu", "hu"], ["fei", "hui"]],
    "digits": {"0": ["ling", "dong"], "1": ["yi", "yao"], "2": ["er", "liang"], "3": ["san"], "4": ["si"], "5": ["wu"], "6": ["liu"], "7": ["qi"], "8": ["ba"], "9": ["jiu"]},
}


@dataclass(frozen=True)
class Vocabulary:
    """The word lists of slot extraction."""

    positions: tuple[str, ...] = tuple(POSITIONS)
    objects: tuple[str, ...] = tuple(OBJECTS)
    handles: tuple[str, ...] = tuple(HANDLES)
    actions: tuple[str, ...] = tuple(ACTIONS)
    checks: tuple[str, ...] = tuple(CHECKS)
    panels: tuple[str, ...] = tuple(PANELS)
    states: tuple[str, ...] = tuple(STATES)
    suffixes: tuple[str, ...] = tuple(SUFFIXES)
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    prefix_chars: str = PREFIX_CHARS


#: Where each word list stands in a YAML file.
VOCABULARY_PATHS = {
    "positions": "positions.values", "objects": "objects.values", "handles": "handles.values", "actions": "actions.values", "checks": "check_markers.values",
    "panels": "panels.values", "states": "states.values", "suffixes": "device_suffixes", "stopwords": "stopwords", "prefix_chars": "device_prefix_chars",
}


@dataclass(frozen=True)
class Settings:
    """All thresholds of matching, alignment and speech analytics."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(SLOT_WEIGHTS))
    required: tuple[str, ...] = REQUIRED
    exact_digits: tuple[str, ...] = EXACT_DIGITS
    discriminative: tuple[str, ...] = DISCRIMINATIVE
    hit: float = 0.75
    sentence_weight: float = 0.25
    extra_penalty: float = 0.12
    passing: float = 0.82
    review: float = 0.60
    missing_fails: bool = False
    lookahead: int = 2
    lookback: int = 1
    chatter: float = 0.45
    role_aware: bool = False
    corroborate: bool = True
    near_field: float = 1.6
    min_speech_ms: int = 300
    assets: tuple[str, ...] = ()

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


#: Where each setting stands in a YAML file, as dotted paths.
YAML_PATHS = {
    "weights": "matcher.slot_weights", "required": "matcher.required_slots", "exact_digits": "matcher.exact_digit_slots", "discriminative": "matcher.discriminative_slots",
    "hit": "matcher.slot_hit_threshold", "sentence_weight": "matcher.sentence_similarity_weight", "extra_penalty": "matcher.extra_slot_penalty",
    "passing": "verdict.pass_threshold", "review": "verdict.review_threshold", "lookahead": "aligner.lookahead", "lookback": "aligner.lookback",
    "chatter": "aligner.chatter_threshold", "role_aware": "aligner.role_aware", "corroborate": "aligner.use_call_corroboration",
    "near_field": "speaker.near_field_rms_ratio", "min_speech_ms": "vad.min_speech_ms",
}


def rooted(path: str | Path, root: str | Path = ".") -> Path:
    """An absolute path as it is; a relative one under root."""
    return Path(path) if Path(path).is_absolute() else Path(root) / path


def dotted(tree: Mapping[str, Any], path: str, default: Any = None) -> Any:
    """The value at a dotted path, or the default where any step is missing."""
    for step in path.split("."):
        if not isinstance(tree, Mapping) or step not in tree:
            return default
        tree = tree[step]
    return tree


def load_vocabulary(path: str | Path, root: str | Path = ".") -> Vocabulary:
    """Word lists from a YAML file; a list that it lacks is empty. A missing file is an error."""
    import yaml

    tree = yaml.safe_load(rooted(path, root).read_text(encoding="utf-8")) or {}
    found = {name: dotted(tree, at) for name, at in VOCABULARY_PATHS.items()}
    return Vocabulary(**{k: v or "" if k == "prefix_chars" else tuple(map(str, v or ())) for k, v in found.items()})


def load(path: str | Path, root: str | Path = ".") -> Settings:
    """Settings from a YAML file; what it doesn't name keeps its default. A missing file is an error."""
    import yaml

    tree = yaml.safe_load(rooted(path, root).read_text(encoding="utf-8")) or {}
    found = {name: dotted(tree, at) for name, at in YAML_PATHS.items()}
    found = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if v is not None}
    found["missing_fails"] = dotted(tree, "verdict.missing_required_action", "review") == "fail"
    return Settings(**found)
