"""What a scan of parsed papers looks for by itself: labels with patterns, the gates that some stand behind, words of phrases."""

from __future__ import annotations

# Labels and the patterns that find them, in any case.
CONCEPTS = (
    ("Q-learning", r"\bQ[\s-]?learning\b"),
    ("SARSA", r"\bSARSA\b"),
    ("TD(lambda)", r"\bTD\s*\(?\s*(?:lambda|\\lambda|λ)\s*\)?|\bTD\s*\(\s*λ\s*\)"),
    ("Reinforcement Learning", r"\breinforcement learning\b"),
    ("TD learning", r"\btemporal difference\s*\(?\s*TD\s*\)?\s+learning\b|\bTD learning\b"),
    ("Temporal difference error", r"\btemporal difference error\b|\bTD error\b"),
    ("Markov Decision Process", r"\bMarkov Decision Process\b"),
    ("MDP", r"\bMDP\b"),
    ("Value function", r"\bvalue function(?:s)?\b"),
    ("Reward function", r"\breward function(?:s)?\b"),
    ("State-action value", r"\bstate-action value\b|\bQ\s*\(\s*s\s*,\s*a\s*\)"),
    ("PPO", r"\bPPO\b|\bProximal Policy Optimization\b"),
    ("A3C", r"\bA3C\b|\bAsynchronous Advantage Actor[-\s]?Critic\b"),
    ("DQN", r"\bDQN\b|\bDeep Q[-\s]?Network(?:s)?\b"),
    ("REINFORCE", r"\bREINFORCE\b"),
    ("Actor-Critic architecture", r"\bActor[-\s]?Critic(?: architecture)?\b"),
    ("Dynamic Programming", r"\bDynamic Programming\b"),
    ("Homeostasis", r"\bhomeostasis\b|\bhomeostatic\b"),
    ("Extrinsic motivation", r"\bextrinsic motivation\b|\bextrinsic/homeostatic\b"),
    ("Intrinsic motivation", r"\bintrinsic motivation\b|\bintrinsic/appraisal\b"),
    ("Motivated reinforcement learning", r"\bmotivated reinforcement learning\b"),
    ("Appraisal theory", r"\bappraisal theor(?:y|ies)\b"),
    ("Prospect Theory", r"\bProspect Theory\b"),
    ("Average reward", r"\baverage reward\b"),
    ("Categorical emotion", r"\bcategorical emotions?\b"),
    ("Dimensional emotion", r"\bdimensional emotions?\b"),
    ("Model-based RL", r"\bmodel[- ]based\s+RL\b|\bmodel[- ]based reinforcement learning\b"),
    ("POMDP", r"\bPOMDP\b|\bPartially Observable Markov Decision Process\b"),
    ("Well-being", r"\bwell[- ]being\b"),
    ("Model uncertainty", r"\bmodel uncertainty\b"),
    ("Novelty", r"\bnovelty\b"),
    ("Recency", r"\brecency\b"),
    ("Control/Power", r"\bcontrol and power\b|\bcontrol/power\b"),
    ("Motivational relevance", r"\bmotivational relevance\b"),
    ("Intrinsic pleasantness", r"\bintrinsic pleasantness\b"),
    ("Social fairness", r"\bsocial fairness\b"),
    ("Social accountability", r"\bsocial accountability\b"),
    ("Valence", r"\bvalence\b|\bvalency\b"),
    ("Arousal", r"\barousal\b"),
    ("Dopamine", r"\bdopamine\b"),
    ("Serotonin", r"\bserotonin\b"),
    ("Noradrenaline", r"\bnoradrenaline\b|\bnorepinephrine\b"),
    ("Acetylcholine", r"\bacetylcholine\b"),
    ("Learning rate", r"\blearning rate\b"),
    ("Discount factor", r"\bdiscount factor\b"),
    ("Boltzmann action selection temperature", r"\bBoltzmann action selection temperature\b"),
    ("Fuzzy logic", r"\bfuzzy logic\b"),
    ("Transition model", r"\btransition models?\b"),
    ("Forward simulation", r"\bforward simulation\b"),
    ("Goal-oriented action planning", r"\bgoal[- ]oriented action planning\b"),
    ("Bio-inspiration", r"\bbio[- ]inspiration\b|\bbio[- ]inspired\b"),
    ("Developmental robotics", r"\bdevelopmental robotics\b"),
    ("Planning community heuristics", r"\bplanning community\b"),
    ("Emotional feedback", r"\bemotional feedback\b"),
    ("Human-robot interaction", r"\bhuman[- ]robot interaction\b"),
    ("Affective modelling", r"\baffective modelling\b|\baffective modeling\b"),
    ("Affective Computing", r"\baffective computing\b"),
    ("Emotion modelling", r"\bemotion(?:al)? model(?:l)?ing\b|\bcomputational emotion models?\b"),
    ("Emotional agents", r"\bemotional agents?\b|\bagents? with emotions?\b"),
    ("Reward shaping", r"\breward shaping\b|\bshap(?:e|ed|ing)\s+rewards?\b"),
    ("Policy gradient", r"\bpolicy gradient(?:s)?\b"),
    ("Value iteration", r"\bvalue iteration\b"),
    ("Multi-agent reinforcement learning", r"\bmulti[- ]agent reinforcement learning\b|\bMARL\b"),
    ("Intrinsic reward", r"\bintrinsic rewards?\b"),
    ("Extrinsic reward", r"\bextrinsic rewards?\b"),
    ("Cognitive appraisal", r"\bcognitive appraisal\b"),
    ("Appraisal dimensions", r"\bappraisal dimensions?\b|\bappraisal variables?\b"),
    ("Human feedback", r"\bhuman feedback\b|\bsocial feedback\b"),
    ("Homeostatic reinforcement learning", r"\bhomeostatic reinforcement learning\b"),
    ("KL-divergence", r"\bKL[- ]divergence\b"),
    ("L1 norm", r"\bL1 norm\b"),
    ("Euclidean distance", r"\bEuclidean distance\b"),
    ("Set point", r"\bset point\b"),
    ("Drive", r"\bdrives?\b"),
    ("Primary reinforcers", r"\bprimary reinforcers\b"),
    ("Emotion elicitation categories", r"\bemotion elicitation categor(?:y|ies)\b"),
    ("Emotion type classification", r"\bemotion type classification\b"),
    ("BERT", r"\bBERT\b"),
    ("RoBERTa", r"\bRoBERTa\b"),
    ("DistilBERT", r"\bDistilBERT\b"),
    ("ELECTRA", r"\bELECTRA\b"),
    ("ELMo", r"\bELMo\b"),
    ("Bi-LSTM", r"\bBi[-\s]?LSTM\b|\bBidirectional LSTM\b|\bBidirectional Long Short[-\s]?Term Memory\b"),
    ("C-LSTM", r"\bC[-\s]?LSTM\b|\bConvolutional LSTM\b"),
    ("Conv-HAN", r"\bConv[-\s]?HAN\b|\bConvolutional Hierarchical Attention Network\b"),
    ("HAN", r"\bHAN\b|\bHierarchical Attention Network\b"),
    ("LSTM", r"\bLSTM\b"),
    ("CNN", r"\bCNN\b|\bConvolutional Neural Network(?:s)?\b"),
    ("Transformer", r"\bTransformer(?:s)?\b"),
    ("GPT", r"\bGPT(?:-\d+(?:\.\d+)?)?\b"),
    ("OCC Model", r"\bOCC\s+model\b|\bOrtony,\s*Clore,\s*(?:and|&)\s*Collins\b"),
    ("PAD Model", r"\bPAD\s+model\b|\bPleasure[-\s]Arousal[-\s]Dominance\b"),
    ("Somatic Marker Hypothesis", r"\bsomatic marker(?: hypothesis)?\b"),
    ("Drive Reduction Theory", r"\bdrive reduction(?: theory)?\b"),
    ("Official Statistics", r"\bofficial statistics\b"),
    ("Data Science", r"\bdata science\b"),
    ("Machine Learning", r"\bmachine learning\b"),
    ("Data Source Changes", r"\bchang(?:e|es|ing)\s+(?:in\s+)?data sources?\b|\bdata sources?\s+chang(?:e|es|ing)\b"),
    ("External Data Sources", r"\bexternal data sources?\b|\balternative data sources?\b"),
    ("Concept Drift", r"\bconcept drift\b"),
    ("Bias", r"\bbias(?:es|ed)?\b"),
    ("Data Availability", r"\bdata availability\b|\bavailability\b"),
    ("Data Validity", r"\bdata validity\b|\bvalidity\b"),
    ("Data Accuracy", r"\bdata accuracy\b|\baccuracy\b"),
    ("Data Completeness", r"\bdata completeness\b|\bcompleteness\b"),
    ("Statistical Neutrality", r"\bstatistical neutrality\b|\bneutrality\b"),
    ("Statistical Reporting", r"\bstatistical reporting\b|\breporting\b"),
    ("Data Source Ownership", r"\bownership\b|\bdata source ownership\b"),
    ("Ethics", r"\bethics?\b|ethical"),
    ("Regulation", r"\bregulation\b|\bregulatory\b"),
    ("Public Perception", r"\bpublic perception\b"),
    ("Privacy", r"\bprivacy\b"),
    ("Robustness", r"\brobustness\b|\brobust\b"),
    ("Monitoring", r"\bmonitoring\b|\bmonitor\b"),
    ("Model Retraining", r"\bretrain(?:ing)?\b|\bmodel retraining\b"),
    ("Data Pipeline", r"\bdata pipelines?\b"),
    ("Data Distribution", r"\bdata distribution\b"),
    ("Derived Data Fields", r"\bderived data fields?\b"),
    ("Data Frequency", r"\bdata frequency\b"),
    ("Data Source Discontinuation", r"\bdiscontinuation\b|\bdiscontinued\b"),
    ("Quantum Machine Learning", r"\bquantum machine learning\b|\bQML\b"),
    ("Photonic Quantum Machine Learning", r"\bphotonic (?:and hybrid )?quantum machine learning\b|\bphotonic QML\b"),
    ("MerLin", r"\bMerLin\b"),
    ("Fock space", r"\bFock[-\s]?space\b|\bFock space\b"),
    ("Linear-optical circuits", r"\blinear[-\s]?optical circuits?\b"),
    ("QuantumLayer", r"\bQuantumLayer\b|\bQuantum Layer\b"),
    ("Angle encoding", r"\bangle encoding\b|\bphase encoding\b"),
    ("Amplitude encoding", r"\bamplitude encoding\b|\bamplitude embedding\b"),
    ("Quantum memristor", r"\bquantum memristors?\b|\bphotonic quantum memristors?\b"),
    ("Fidelity Kernel", r"\bfidelity[-\s]?based kernel\b|\bfidelity kernel\b|\bquantum fidelity kernel\b"),
    ("Adaptive state injection", r"\badaptive state injection\b"),
    ("Quantum Convolutional Neural Network", r"\bQCNNs?\b|\bquantum convolutional neural networks?\b"),
    ("Quantum Generative Adversarial Network", r"\bQGANs?\b|\bquantum generative adversarial networks?\b"),
    ("Quantum Long Short-Term Memory", r"\bQLSTM\b|\bQuantum LSTM\b|\bQuantum Long Short[-\s]?Term Memory\b"),
    ("Quantum Relational Knowledge Distillation", r"\bQRKD\b|\bQuantum Relational Knowledge Distillation\b"),
    ("Strong Linear Optical Simulation", r"\bSLOS\b|\bStrong Linear Optical Simulation\b"),
    ("Quantum Reservoir Computing", r"\bquantum reservoir computing\b|\bquantum optical reservoir computing\b"),
    ("QLOQ", r"\bQLOQ\b"),
    ("MNIST", r"\bMNIST\b"),
    ("CIFAR-10", r"\bCIFAR[-\s]?10\b|\bCIFAR10\b"),
    ("SST2", r"\bSST[-\s]?2\b|\bSST2\b|Stanford Sentiment Treebank 2"),
    ("Temporal entanglement", r"\btemporal entanglement\b"),
    ("Pointer states", r"\bpointer states?\b"),
    ("Synesthesia", r"\bsyn(?:a)?esthesia\b"),
    ("Cross-domain mapping", r"\bcross[-\s]?domain mappings?\b|\bcross[-\s]?modal mappings?\b"),
    ("Unruptured Intracranial Aneurysm", r"\bUIAs?\b|\bunruptured intracranial aneurysms?\b"),
    ("TOF-MRA", r"\bTOF[-\s]?MRA\b|\btime[-\s]?of[-\s]?flight magnetic resonance angiography\b"),
    ("ADAM dataset", r"\bAneurysm Detection And segMentation\b|\bADAM dataset\b"),
    ("ADAM challenge", r"\bADAM challenge\b"),
    ("PHASES score", r"\bPHASES score\b"),
    ("Computer-aided detection", r"\bcomputer[-\s]?aided detection\b|\bCAD system\b|\bCAD tool\b"),
    ("3D U-Net", r"\b3D[-\s]?U[-\s]?Net\b|\b3D UNET\b"),
    ("Satisfaction of Search", r"\bsatisfaction[-\s]?of[-\s]?search(?: effect)?\b"),
    ("McNemar's test", r"\bMcNemar[’']?s test\b"),
    ("Wilcoxon signed-rank test", r"\bWilcoxon signed[-\s]?rank tests?\b"),
)
# Labels that count only in papers of a kind (a gate).
RL_EMOTION_LABELS = (
    "Homeostasis",
    "Extrinsic motivation",
    "Intrinsic motivation",
    "Motivated reinforcement learning",
    "Appraisal theory",
    "Prospect Theory",
    "Average reward",
    "Categorical emotion",
    "Dimensional emotion",
    "Model-based RL",
    "POMDP",
    "Well-being",
    "Model uncertainty",
    "Novelty",
    "Recency",
    "Control/Power",
    "Motivational relevance",
    "Intrinsic pleasantness",
    "Social fairness",
    "Social accountability",
    "Valence",
    "Arousal",
    "Dopamine",
    "Serotonin",
    "Noradrenaline",
    "Acetylcholine",
    "Learning rate",
    "Discount factor",
    "Boltzmann action selection temperature",
    "Fuzzy logic",
    "Transition model",
    "Forward simulation",
    "Goal-oriented action planning",
    "Bio-inspiration",
    "Developmental robotics",
    "Planning community heuristics",
    "Emotional feedback",
    "Human-robot interaction",
    "Affective modelling",
    "Affective Computing",
    "Emotion modelling",
    "Emotional agents",
    "Reward shaping",
    "Policy gradient",
    "Value iteration",
    "Multi-agent reinforcement learning",
    "Intrinsic reward",
    "Extrinsic reward",
    "Cognitive appraisal",
    "Appraisal dimensions",
    "Human feedback",
    "Homeostatic reinforcement learning",
    "KL-divergence",
    "L1 norm",
    "Euclidean distance",
    "Set point",
    "Drive",
    "Primary reinforcers",
    "Emotion elicitation categories",
    "Emotion type classification",
)
OFFICIAL_STATISTICS_LABELS = (
    "Official Statistics",
    "Data Source Changes",
    "External Data Sources",
    "Concept Drift",
    "Bias",
    "Data Availability",
    "Data Validity",
    "Data Accuracy",
    "Data Completeness",
    "Statistical Neutrality",
    "Statistical Reporting",
    "Data Source Ownership",
    "Ethics",
    "Regulation",
    "Public Perception",
    "Privacy",
    "Robustness",
    "Monitoring",
    "Model Retraining",
    "Data Pipeline",
    "Data Distribution",
    "Derived Data Fields",
    "Data Frequency",
    "Data Source Discontinuation",
)
QUANTUM_LABELS = (
    "Quantum Machine Learning",
    "Photonic Quantum Machine Learning",
    "MerLin",
    "Fock space",
    "Linear-optical circuits",
    "QuantumLayer",
    "Angle encoding",
    "Amplitude encoding",
    "Quantum memristor",
    "Fidelity Kernel",
    "Adaptive state injection",
    "Quantum Convolutional Neural Network",
    "Quantum Generative Adversarial Network",
    "Quantum Long Short-Term Memory",
    "Quantum Relational Knowledge Distillation",
    "Strong Linear Optical Simulation",
    "Quantum Reservoir Computing",
    "QLOQ",
    "MNIST",
    "CIFAR-10",
    "SST2",
)
# Methods and their patterns, in papers of official statistics and in those of emotion in reinforcement learning.
STATISTICS_METHODS = (
    ("Checklist for Changing Data Sources", r"\bchecklist\b"),
    ("Data Source Monitoring", r"\bmonitor(?:ing)? changes? in (?:incoming )?data\b|\bmonitoring\b"),
    ("Robust Data Sourcing", r"\brobust(?:ness)? in (?:both )?data sourcing\b|\brobust data sourcing\b"),
    ("Robust Statistical Techniques", r"\brobust(?:ness)? in .*statistical techniques\b|\brobust statistical techniques\b"),
    ("Model Retraining", r"\bperiodically reevaluate and retrain models\b|\bretrain(?:ing)? models\b"),
    ("Data Pipeline Monitoring", r"\bdata pipelines? should (?:be designed to )?monitor\b|\bpipeline monitoring\b"),
    ("Precautionary Measures", r"\bprecautionary measures\b"),
)
RL_EMOTION_METHODS = (
    ("Q-learning", r"\bQ[\s-]?learning\b"),
    ("SARSA", r"\bSARSA\b"),
    ("TD(lambda)", r"\bTD\s*\(?\s*(?:lambda|\\lambda|Î»|λ)\s*\)?|\bTD\s*\(\s*(?:Î»|λ)\s*\)"),
    ("Actor-Critic", r"\bActor[-\s]?Critic\b"),
    ("Dynamic Programming", r"\bDynamic Programming\b"),
    ("Reward shaping", r"\breward shaping\b|\bshap(?:e|ed|ing)\s+rewards?\b"),
    ("Policy gradient", r"\bpolicy gradient(?:s)?\b"),
    ("Value iteration", r"\bvalue iteration\b"),
    ("Homeostatic reinforcement learning", r"\bhomeostatic reinforcement learning\b"),
    ("Appraisal-based reward modulation", r"\bappraisal\b.{0,80}\breward\b|\breward\b.{0,80}\bappraisal\b"),
)
# How sure a find is, by where it comes from.
SURE = {"concept": 0.74, "statistics_method": 0.74, "rl_method": 0.76, "long_form": 0.68, "short_form": 0.62, "heading": 0.64, "phrase": 0.60}
# Words of which a heading has one.
HEADING_WORDS = r"\b(data|source|statistics|machine learning|bias|validity|accuracy|availability|ownership|ethics|regulation|privacy|monitoring|robustness|concept drift|frequency|completeness|neutrality)\b"
# Words of which a repeated phrase has one, words that it doesn't begin or end with, words of which one must be another, and its length.
PHRASES = {
    "official": (
        "data statistical statistics machine model source quality concept public privacy regulation ownership".split(),
        "the and for with from that this are can will have has".split(),
        (),
        (8, 1000),
    ),
    "rl_emotion": (
        "reinforcement learning emotion emotional affective appraisal reward policy value agent robot human motivation homeostatic drive".split(),
        "the and for with from that this are can will have has paper article".split(),
        "reinforcement learning agent agents robot robots human humans".split(),
        (10, 70),
    ),
}
# Words of names that aren't long forms of a short one, and first words of such.
NO_LONG_FORM = "conference proceedings journal transactions symposium congress workshop vol pp".split()
NO_FIRST_WORD = "for in the this these those a an we".split()
