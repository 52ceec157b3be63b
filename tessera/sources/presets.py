"""Formats and masks of well-known kinds of logs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Preset:
    """``format``: literal parts are regular expressions, `<Field>` is a column. ``masks``: values to replace."""

    format: str
    masks: tuple[str, ...] = field(default=())


#: Fixed values.
PRESETS = {
    "HDFS": Preset("<Date> <Time> <Pid> <Level> <Component>: <Content>", (r"/?(\d+\.){3}\d+(:\d+)?",)),
    "Hadoop": Preset(r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>"),
    "Spark": Preset("<Date> <Time> <Level> <Component>: <Content>"),
    "Zookeeper": Preset(r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>", (r"(/|)(\d+\.){3}\d+(:\d+)?",)),
    "BGL": Preset("<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>"),
    "HPC": Preset("<LogId> <Node> <Component> <State> <Time> <Flag> <Content>", (r"node-D?\d+\\?", r"node-D?\[.*?\]")),
    "Thunderbird": Preset(r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>"),
    "Linux": Preset(r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>", (r"J([a-z]{2})",)),
    "HealthApp": Preset(r"<Time>\|<Component>\|<Pid>\|<Content>"),
    "Apache": Preset(r"\[<Time>\] \[<Level>\] <Content>", (r"HTTP/\d\.\d",)),
    "Proxifier": Preset(r"\[<Time>\] <Program> - <Content>", (r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"[KGTM]B")),
    "OpenSSH": Preset(r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>", (r"([\w-]+\.){2,}[\w-]+", r"HTTP/\d\.\d")),
    "OpenStack": Preset(r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>", (r"HTTP/\d\.\d",)),
    "Mac": Preset(r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>", (r"([\w-]+\.){2,}[\w-]+",)),
    "LoFI": Preset("<Content>", (r"(?<=request-id:)routeid(?=,)",)),
    "CTS": Preset(r"\[<ID>\]\[<Process>\] <Content>", (r"\d+/\d+/\d+$",)),
    "HiBench": Preset(r"\[<Time>\] <Content>", (r"hdfs://[a-zA-Z0-9._-]+(/[a-zA-Z0-9._/-]*)*", r"^/[a-zA-Z0-9._-]+(/[a-zA-Z0-9._-]*)*")),
}
