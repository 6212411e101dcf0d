"""Fixed scoring trees as data, and trees as column or SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A node is (feature, threshold, left, right), left taken when feature <= threshold.
# A leaf is (share of normal, share of attack).
# Thresholds and leaf shares of the four recorded trees.
DEPLOYED = (
    "deauth_packets", 0.5,
    ("total_packets", 249.5,
     ("total_packets", 27.5,
      ("total_packets", 6.5,
       (0.5851499480832648, 0.41485005191673524),
       (0.5037664720061669, 0.4962335279938332)),
      ("packet_density", 2696.9000244140625,
       (0.12816100396633834, 0.8718389960336617),
       (0.4836914414168635, 0.5163085585831364))),
     ("packet_density", 4758.150146484375,
      ("packet_density", 3646.550048828125,
       (0.44633099661486786, 0.5536690033851321),
       (0.7025134264232005, 0.2974865735767995)),
      ("total_packets", 477.5,
       (0.8411311915659425, 0.15886880843405757),
       (0.9315065782965676, 0.06849342170343246)))),
    ("packet_density", 195.0,
     ("deauth_targeted", 0.5,
      ("seq_jump", 0.5,
       (0.0, 1.0),
       (0.8198938716054521, 0.18010612839454798)),
      ("packet_density", 175.5999984741211,
       (0.0, 1.0),
       (1.0, 0.0))),
     ("total_packets", 299.0,
      ("total_packets", 4.5,
       (0.018614759519984876, 0.9813852404800152),
       (0.0, 1.0)),
      (1.0, 0.0))),
)
PHASE_A = (
    "heap", 69784.0,
    ("heap", 68124.0,
     ("heap", 65842.0,
      ("heap", 65806.0,
       (0.8608666180533436, 0.1391333819466563),
       (0.20772051334284022, 0.7922794866571599)),
      ("heap", 65908.0,
       (0.9922251676837405, 0.007774832316259522),
       (0.2800658978583195, 0.7199341021416805))),
     ("snr_mean", 19.5,
      ("heap", 69764.0,
       (0.13648269840540408, 0.8635173015945959),
       (0.6749721085905541, 0.3250278914094459)),
      ("deauth_packets", 0.5,
       (0.06460622830144369, 0.9353937716985563),
       (0.0, 1.0)))),
    ("snr_mean", 10.75,
     ("snr_mean", -2.5,
      ("rssi_mean", -93.5,
       (0.7486579754601228, 0.2513420245398773),
       (0.5374155199088022, 0.4625844800911978)),
      ("rssi_mean", -80.5,
       (0.842102886048507, 0.15789711395149295),
       (0.6937631394533987, 0.30623686054660126))),
     ("snr_mean", 24.75,
      ("snr_mean", 19.25,
       (0.47810168960588956, 0.5218983103941103),
       (0.7199316385387732, 0.2800683614612269)),
      ("rssi_mean", -64.25,
       (0.16338790599419054, 0.8366120940058095),
       (0.5465812494645558, 0.4534187505354442)))),
)
WIRELESS_ONLY = (
    "rssi_var", 100.57986068725586,
    ("snr_mean", 32.35000038146973,
     ("rssi_var", 4.59375,
      ("rssi_mean", -69.8125,
       (0.5502150924574438, 0.4497849075425561),
       (0.8163650950464454, 0.18363490495355453)),
      ("total_packets", 430.5,
       (0.0793740330067045, 0.9206259669932956),
       (1.0, 0.0))),
     ("deauth_packets", 0.5,
      ("rssi_mean", -52.06944465637207,
       (0.21709633649932067, 0.7829036635006793),
       (1.0, 0.0)),
      (0.0, 1.0))),
    ("packet_density", 2665.050048828125,
     ("snr_mean", 36.64999961853027,
      (0.0, 1.0),
      ("deauth_packets", 0.5,
       (1.0, 0.0),
       (0.0, 1.0))),
     ("total_packets", 225.0,
      ("rssi_mean", -62.29999923706055,
       (0.1594367109096795, 0.8405632890903205),
       (1.0, 0.0)),
      ("rssi_mean", -62.82575607299805,
       (0.9508531841798925, 0.04914681582010742),
       (1.0, 0.0)))),
)
MATCHED_FULL = (
    "udpfail", 12994.0,
    (1.0, 0.0),
    ("deauth_packets", 0.5,
     ("rssi_var", 110.3225326538086,
      ("heap", 65268.0,
       (0.17371822153601066, 0.8262817784639893),
       (0.47882482665255804, 0.521175173347442)),
      ("packet_density", 2670.7000732421875,
       (0.06640598665138543, 0.9335940133486146),
       (0.9673093992559159, 0.03269060074408416))),
     ("snr_mean", 3.0,
      (1.0, 0.0),
      ("packet_density", 57.95000076293945,
       (1.0, 0.0),
       (0.0017371460013897117, 0.9982628539986103)))),
)
TREES = {
    "deployed": DEPLOYED, "phase_a": PHASE_A, "wireless_only": WIRELESS_ONLY, "matched_full": MATCHED_FULL,
}


def is_leaf(node: tuple) -> bool:
    return len(node) == 2


def tree_sql(node: tuple, leaf: str = "prob") -> str:
    """The tree as one CASE expression: attack share (``prob``) or decision (``pred``)."""
    if is_leaf(node):
        normal, attack = node
        return str(int(attack > normal)) if leaf == "pred" else f"cast('{attack!r}' as double)"
    feature, threshold, left, right = node
    return (
        f"case when {feature} <= cast('{threshold!r}' as double) then {tree_sql(left, leaf)}"
        f" else {tree_sql(right, leaf)} end"
    )


def tree_prob(node: tuple) -> Column:
    """Share of attack in the leaf a row falls into."""
    return F.expr(tree_sql(node, "prob"))


def tree_pred(node: tuple) -> Column:
    """1 iff the leaf holds more attack than normal; a tie is 0."""
    return F.expr(tree_sql(node, "pred"))


def tree_rules(node: tuple, depth: int = 0) -> list[str]:
    """Readable rules, one line per branch or leaf."""
    pad = "|   " * depth + "|--- "
    if is_leaf(node):
        return [f"{pad}class: {int(node[1] > node[0])}"]
    feature, threshold, left, right = node
    return [
        f"{pad}{feature} <= {threshold:.2f}", *tree_rules(left, depth + 1),
        f"{pad}{feature} >  {threshold:.2f}", *tree_rules(right, depth + 1),
    ]


def tree_from_model(model, features: list[str] | tuple[str, ...]) -> tuple:
    """Nodes of a fitted MLlib tree in the same form; split features by name."""
    def walk(node) -> tuple:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            total = sum(stats) or 1.0
            return (stats[0] / total, stats[1] / total)
        split = node.split()
        return (
            features[split.featureIndex()], float(split.threshold()),
            walk(node.leftChild()), walk(node.rightChild()),
        )

    return walk(model._java_obj.rootNode())


def tree_node_rows(node: tuple, node_id: int = 1) -> list[tuple]:
    """(node_id, feature, threshold, p_normal, p_attack); children are 2i and 2i+1."""
    if is_leaf(node):
        return [(node_id, None, None, float(node[0]), float(node[1]))]
    feature, threshold, left, right = node
    return [
        (node_id, feature, float(threshold), None, None),
        *tree_node_rows(left, 2 * node_id), *tree_node_rows(right, 2 * node_id + 1),
    ]
