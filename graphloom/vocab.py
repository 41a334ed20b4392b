"""Vocabularies that are part of the semantics, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Relations in index order with their display text and priority.
RELATIONS = [
    ("antonym", "antonym", 3),
    ("atlocation", "at location", 1),
    ("capableof", "capable of", 0),
    ("causes", "causes", 1),
    ("createdby", "created by", 1),
    ("isa", "is a", 0),
    ("desires", "desires", 2),
    ("hassubevent", "has subevent", 1),
    ("partof", "part of", 0),
    ("hascontext", "has context", 2),
    ("hasproperty", "has property", 1),
    ("madeof", "made of", 0),
    ("notcapableof", "not capable of", 2),
    ("notdesires", "not desires", 2),
    ("receivesaction", "receives action", 1),
    ("relatedto", "related to", 4),
    ("usedfor", "used for", 0),
]
DEFAULT_PRIORITY = 5
RELATEDTO = 15
RELATEDTO_KEEP_RATE = 0.2
MAX_SHORTEST_PATHS = 32

# Five prompts for each task, by slot.
PROMPTS = {
    "node_description": [
        "List all nodes of the graph shown in the image.",
        "Provide the names of all nodes displayed in the graph image.",
        "Can you name all the nodes shown in the graph image?",
        "Identify all the vertices in the diagram of the graph provided.",
        "Detail all the vertices from the graph depicted in the image.",
    ],
    "highest_node_degree": [
        "Name one of the node with the highest degree in the graph. And what is its degree?",
        "Identify one of the node that has the most connections in the graph and specify its degree.",
        "Can you tell me which node (name one) has the highest degree in this graph and what that degree is?",
        "Provide the name and degree of the node with the most connections in the graph.",
        "Which node in the graph has the greatest number of connections, and what is that total?",
    ],
    "node_degree": [
        'What is the degree of the node with the name "{node}"?',
        'What is the degree of the node labeled "{node}"?',
        'Can you tell me the degree of the node named "{node}"?',
        'What is the total number of connections that the node "{node}" has?',
        'How many connections does the node "{node}" have?',
    ],
    "node_number": [
        "How many nodes are there in the graph?",
        "What is the total number of nodes in the graph?",
        "Can you tell me how many nodes are in the graph?",
        "What is the total number of vertices in the graph?",
        "How many vertices are there in the graph?",
    ],
    "edge_number": [
        "How many edges are there in the graph?",
        "What is the total number of edges in the graph?",
        "Can you tell me how many edges are in the graph?",
        "What is the total number of connections in the graph?",
        "How many connections are there in the graph?",
    ],
    "triple_listing": [
        "List all the triples in the graph.",
        "Provide all the triples in the graph.",
        "Can you list all the triples in the graph?",
        "Detail all the triples in the graph.",
        "Enumerate all the triples in the graph.",
    ],
    "relation_identification": [
        'What relation connects the nodes "{node_a}" and "{node_b}"?',
        'What is the relationship between "{node_a}" and "{node_b}" in the graph?',
        'Which relation links "{node_a}" to "{node_b}"?',
        'Name the relation on the edge between "{node_a}" and "{node_b}".',
        'How are the nodes "{node_a}" and "{node_b}" related in the graph?',
    ],
    "neighbor_listing": [
        'List all nodes directly connected to "{node}".',
        'Which nodes share an edge with "{node}"?',
        'Name every neighbor of the node "{node}".',
        'Provide all nodes adjacent to "{node}" in the graph.',
        'What nodes is "{node}" connected to?',
    ],
    "shortest_path_listing": [
        'List the nodes on the shortest path from "{node_a}" to "{node_b}".',
        'Give the sequence of nodes connecting "{node_a}" to "{node_b}" by the shortest route.',
        'What is the shortest chain of nodes from "{node_a}" to "{node_b}"?',
        'Trace the shortest path between "{node_a}" and "{node_b}", naming each node.',
        'Provide the shortest sequence of nodes linking "{node_a}" and "{node_b}".',
    ],
}


def relation_table(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text, p) for i, (name, text, p) in enumerate(RELATIONS)]
    return spark.createDataFrame(rows, "rel int, relation string, relation_text string, priority int")


def prompt_table(spark: SparkSession) -> DataFrame:
    rows = [(t, i, p) for t, ps in PROMPTS.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "task_type string, slot int, template string")


RELATION_SQL = "relation(rel, relation, relation_text, priority) AS (VALUES " + ", ".join(f"({i}, '{n}', '{t}', {p})" for i, (n, t, p) in enumerate(RELATIONS)) + ")"
