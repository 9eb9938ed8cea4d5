"""Processes of one task that hold a part of its rows each; what they add up meets in memory they share."""

from __future__ import annotations

import mmap
import multiprocessing
import os
import pickle
import re
from collections.abc import Callable
from multiprocessing.connection import Connection
from typing import TypeVar

import numpy as np
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession

T = TypeVar("T")
#: Numbers of a process that meet at once; larger arrays take several turns.
TURN = 1 << 17
#: More processes spend what they gain on meeting.
MOST_PROCESSES = 4


class Team:
    """One of the processes. All call the same methods in the same order."""

    def __init__(self, place: int = 0, size: int = 1, memory: mmap.mmap | None = None, pipes: list[Connection] | None = None):
        self.place, self.size, self.pipes, self.turn = place, size, pipes or [], 0
        self.slots = np.frombuffer(memory, float).reshape(2, size, TURN) if memory else None

    def sum(self, own: np.ndarray) -> np.ndarray:
        """The sum of the arrays of all. Turns alternate between two slots, so nobody writes where another may still read."""
        if self.size == 1:
            return own
        flat = own.ravel()
        out = np.empty(len(flat))
        for start in range(0, len(flat), TURN):
            part = flat[start:start + TURN]
            slots = self.slots[self.turn, :, :len(part)]
            self.turn ^= 1
            slots[self.place] = part
            self.gather(None)
            slots.sum(axis=0, out=out[start:start + TURN])
        return out.reshape(own.shape)

    def gather(self, own: T) -> list[T]:
        """The values of all, by place. The first process waits for the others and tells them."""
        if self.place:
            self.pipes[0].send_bytes(pickle.dumps(own))
            return [pickle.loads(v) for v in pickle.loads(self.pipes[0].recv_bytes())]
        found = [pickle.dumps(own), *(p.recv_bytes() for p in self.pipes)]
        told = pickle.dumps(found)
        for p in self.pipes:
            p.send_bytes(told)
        return [own, *map(pickle.loads, found[1:])]


def _help(work: Callable[[Team], T], place: int, size: int, memory: mmap.mmap, pipe: Connection, others: list[Connection]) -> None:
    for other in others:  # held by the first process alone, so that its end is seen
        other.close()
    try:
        work(Team(place, size, memory, [pipe]))
    except (EOFError, ConnectionError):
        pass  # the first process has ended and says why


def together(size: int, work: Callable[[Team], T]) -> T:
    """What work returns in this process, with size - 1 forks of it at work beside it. If one of them ends early, this raises."""
    if size == 1 or not hasattr(os, "fork"):
        return work(Team())
    fork, memory = multiprocessing.get_context("fork"), mmap.mmap(-1, 2 * size * TURN * 8)
    pipes, helpers = [], []
    try:
        for place in range(1, size):
            here, there = fork.Pipe()
            pipes.append(here)
            helpers.append(fork.Process(target=_help, args=(work, place, size, memory, there, list(pipes)), daemon=True))
            helpers[-1].start()
            there.close()
        return work(Team(0, size, memory, pipes))
    except (EOFError, ConnectionError) as error:
        raise RuntimeError("a process of the task ended early") from error
    finally:
        for pipe in pipes:
            pipe.close()
        for helper in helpers:
            helper.join()


def _executors(spark: SparkSession) -> tuple[int, int]:
    """(how many there are, cores of each)."""
    sc = spark.sparkContext
    conf, executors = sc.getConf(), max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)
    local = re.match(r"local\[(\d+|\*)", sc.master)
    if local:
        cores = (os.cpu_count() or 1) if local[1] == "*" else int(local[1])
    elif conf.contains("spark.executor.cores"):
        cores = int(conf.get("spark.executor.cores"))
    else:
        cores = 1 if conf.contains("spark.default.parallelism") else sc.defaultParallelism // executors
    return executors, cores


def free_cores(spark: SparkSession, tasks: int) -> int:
    """Cores that each of so many tasks has if nothing else runs."""
    executors, cores = _executors(spark)
    return max(1, min(MOST_PROCESSES, cores // -(-tasks // executors)))


def teams_at_once(spark: SparkSession, cores: int) -> int:
    """Tasks of so many cores that run beside each other."""
    executors, own = _executors(spark)
    return executors * max(1, own // cores)


def with_cores(spark: SparkSession, cores: int) -> ResourceProfile | None:
    """The profile of tasks that hold so many cores. A local master has none, nor need of one: its only executor is idle beside."""
    if cores == 1 or re.match(r"local(\[|$)", spark.sparkContext.master):
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build
